"""The predicate language: nested dictionaries compiled to column expressions and semi-joins.

    {"number_gte": 3, "OR": [{"text_contains": "a"}, {"NOT": {"id_in": [...]}}], "verses_some": {...}}

Keys are a field with an optional operator suffix, AND, OR, NOT, or the name of a relationship (`name_some` for lists,
`name` for single ones) with a nested dictionary. Keys of one dictionary are conjoined. Nulls follow three-valued logic, so
`_not` and `_nin` drop them; an empty AND is true, an empty OR false, an empty dictionary true; `_regex` matches the whole.

A relationship becomes a column that says whether a row has a match, by a left join with the distinct matching keys: it
can then stand anywhere in a boolean expression, which a bare semi-join can't. A relationship at the top is a semi-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "_gt": lambda c, v: c > v,
    "_gte": lambda c, v: c >= v,
    "_lt": lambda c, v: c < v,
    "_lte": lambda c, v: c <= v,
    "_contains": lambda c, v: c.contains(v),
    "_startsWith": lambda c, v: c.startswith(v),
    "_endsWith": lambda c, v: c.endswith(v),
    "_regex": lambda c, v: c.rlike(f"^(?:{v})\\z"),
    "_in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "_nin": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
    "_not": lambda c, v: c != v,
    "_isNull": lambda c, v: c.isNull() if v else c.isNotNull(),
}
TEXT_ONLY = {"_contains", "_startsWith", "_endsWith", "_regex"}


@dataclass
class Link:
    """How rows of a label reach another label: through `edges` (near and far key columns, and properties), to `target`."""

    edges: DataFrame
    near: str
    far: str
    target: Label
    properties: tuple[str, ...] = ()


@dataclass
class Label:
    """A node table with its key and the relationships by field name."""

    nodes: DataFrame
    key: str = "id"
    links: dict[str, Link] = field(default_factory=dict)


def split_key(name: str) -> tuple[str, str]:
    for suffix in sorted(OPERATORS, key=len, reverse=True):
        if name.endswith(suffix):
            return name[: -len(suffix)], suffix
    return name, ""


def matching_keys(link: Link, where: dict, column: str) -> DataFrame:
    """Near keys of edges whose far end satisfies the predicate."""
    reached = filtered(link.target, where).select(F.col(link.target.key).alias("quern_far"))
    return link.edges.join(reached, F.col(link.far) == F.col("quern_far"), "left_semi").select(F.col(link.near).alias(column))


def _compile(label: Label, where: dict, needed: list[tuple[str, Link, dict]]) -> Column:
    parts = []
    for name, value in where.items():
        if name in ("AND", "OR"):
            inner = [_compile(label, w, needed) for w in value]
            parts.append(reduce((lambda a, b: a & b) if name == "AND" else (lambda a, b: a | b), inner, F.lit(name == "AND")) if inner else F.lit(name == "AND"))
        elif name == "NOT":
            parts.append(~_compile(label, value, needed))
        elif name.removesuffix("_some") in label.links and isinstance(value, dict):
            column = f"quern_has_{len(needed)}"
            needed.append((column, label.links[name.removesuffix("_some")], value))
            parts.append(F.col(column))
        else:
            column, operator = split_key(name)
            kind = dict(label.nodes.dtypes).get(column)
            if kind is None:
                raise ValueError(f"no such field: {name}")
            if operator in TEXT_ONLY and kind != "string":
                raise ValueError(f"{name}: {column} isn't text")
            parts.append(OPERATORS[operator](F.col(column), value) if operator else F.col(column) == value)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def filtered(label: Label, where: dict | None) -> DataFrame:
    """Rows of the label that satisfy the predicate."""
    where = where or {}
    rows = label.nodes
    for name in [k for k, v in where.items() if k.removesuffix("_some") in label.links and isinstance(v, dict)]:
        keys = matching_keys(label.links[name.removesuffix("_some")], where[name], "quern_near")
        rows = rows.join(keys, F.col(label.key) == F.col("quern_near"), "left_semi")
    rest = {k: v for k, v in where.items() if not (k.removesuffix("_some") in label.links and isinstance(v, dict))}
    needed: list[tuple[str, Link, dict]] = []
    condition = _compile(label, rest, needed)
    for column, link, inner in needed:
        keys = matching_keys(link, inner, f"{column}_key").distinct().withColumn(column, F.lit(True))
        rows = rows.join(keys, F.col(label.key) == F.col(f"{column}_key"), "left").withColumn(column, F.coalesce(column, F.lit(False)))
    return rows.where(condition).select(*label.nodes.columns)
