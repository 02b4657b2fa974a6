"""Nested selections compiled to joins: nodes with, below each, pages of what they are connected to.

    {"where": {...}, "sort": [{"number": "ASC"}], "fields": ["id", "number"],
     "versesConnection": {"first": 3, "after": cursor, "where": {...}, "sort": [...], "fields": [...], "properties": [...], "totalCount": True,
                          "crossRefsOutConnection": {...}}}

`<field>Connection` names a link of the label; its value may hold further connections. A level is one join of the edges with the target,
for all parents together, and one page for each parent: a window whose limit Spark applies in every task before it shuffles, so a parent that
holds a third of all edges sends no more than a page from each. Levels meet by key; a node that many parents show is expanded once.

The order within a parent is that of the sort fields, then the target's key, then the edge's properties (parallel edges); nulls come last when
ascending and first when descending. A cursor holds these values as text, as `paging` makes them, so pages continue by comparison, not by
number. `after` is one cursor for all parents or a table of (parent, cursor), one row a parent, which lets every parent go on from its own
page; parents that aren't in it begin at the beginning. Without `first` all rows come: an array of that size for each parent.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paging import sort_columns
from .predicates import Label, filtered

SUFFIX = "Connection"


@dataclass
class Page:
    """What is shown of one level."""

    first: int | None = None
    after: str | DataFrame | None = None
    where: dict | None = None
    sort: list[dict[str, str]] = field(default_factory=list)
    fields: list[str] | None = None
    properties: list[str] | None = None
    total: bool = False
    below: dict[str, Page] = field(default_factory=dict)


def parsed(selection: dict[str, Any]) -> Page:
    """The nested dictionary as pages."""
    known = {"first": "first", "after": "after", "where": "where", "sort": "sort", "fields": "fields", "properties": "properties", "totalCount": "total"}
    page = Page()
    for name, value in selection.items():
        if name in known:
            setattr(page, known[name], value)
        elif name.endswith(SUFFIX) and isinstance(value, dict):
            page.below[name.removesuffix(SUFFIX)] = parsed(value)
        else:
            raise ValueError(f"not part of a selection: {name}")
    if page.first is not None and page.first < 0:
        raise ValueError("first must not be negative")
    return page


def cursor_of(values: list[Column]) -> Column:
    """The cursor of a row: its sort values as a list of texts."""
    texts = F.array(*(v.cast("string") for v in values))
    return F.translate(F.base64(F.to_json(texts).cast("binary")), "+/\r\n", "-_")


def cursor_values(cursor: Column, kinds: list[str]) -> list[Column]:
    """The values of a cursor, as columns of the given types; what isn't a cursor of so many values is an error."""
    texts = F.from_json(F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string"), "array<string>")
    texts = F.when(F.size(texts) == len(kinds), texts).otherwise(F.raise_error(F.lit("not a cursor")).cast("array<string>"))
    return [F.get(texts, F.lit(i)).cast(k) for i, k in enumerate(kinds)]


def beyond_values(keys: list[tuple[Column, str]], values: list[Column]) -> Column:
    """Rows after the given values, in the order of sort_columns."""
    options: list[Column] = []
    same = F.lit(True)
    for (c, direction), v in zip(keys, values, strict=True):
        if direction == "ASC":
            after = v.isNotNull() & (c.isNull() | (c > v))
        else:
            after = F.when(v.isNull(), c.isNotNull()).otherwise(c < v)
        options.append(same & F.coalesce(after, F.lit(False)))
        same = same & c.eqNullSafe(v)
    return reduce(lambda a, b: a | b, options)


def _order(page: Page, key: str, properties: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column of the matches, direction) of all sort keys."""
    given = [x for s in page.sort for x in s.items()]
    sort_columns(page.sort, key)  # raises on a bad direction
    return [(f"n_{c}", d) for c, d in [*given, (key, "ASC")]] + [(f"p_{p}", "ASC") for p in properties]


def _matches(label: Label, name: str, page: Page, parents: DataFrame | None) -> DataFrame:
    """parent, n_<column of the target>, p_<property> of every edge of the field that leads to a node of the page's filter."""
    link = label.links[name]
    edges = link.edges.select(F.col(link.near).alias("parent"), F.col(link.far).alias("quern_far"), *(F.col(p).alias(f"p_{p}") for p in link.properties)).where("parent is not null")
    if parents is not None:
        edges = edges.join(parents.select(F.col("parent").alias("quern_parent")), F.col("parent") == F.col("quern_parent"), "left_semi")
    reached = filtered(link.target, page.where)
    reached = reached.select(*(F.col(c).alias(f"n_{c}") for c in reached.columns))
    return edges.join(reached, F.col("quern_far") == F.col(f"n_{link.target.key}")).drop("quern_far")


def page_rows(label: Label, name: str, page: Page, parents: DataFrame | None = None) -> DataFrame:
    """parent, nth, cursor, more (was there a row before this page), n_* and p_*: of each parent `first` rows and one, which tells
    whether another page follows."""
    if name not in label.links:
        raise ValueError(f"no such connection: {name}")
    link = label.links[name]
    rows = _matches(label, name, page, parents)
    keys = _order(page, link.target.key, link.properties)
    missing = [c for c, _ in keys if c not in rows.columns]
    if missing:
        raise ValueError(f"no such field to sort by: {missing[0].removeprefix('n_')}")
    kinds = dict(rows.dtypes)
    columns = [(F.col(c), d) for c, d in keys]
    rows = rows.withColumn("more", F.lit(page.after is not None and isinstance(page.after, str)))
    if page.after is not None:
        if isinstance(page.after, str):
            cursor = F.lit(page.after)
        else:
            parent, mark = page.after.columns[:2]
            own = page.after.select(F.col(parent).alias("quern_of"), F.col(mark).alias("quern_mark"))
            rows = rows.join(own, F.col("parent") == F.col("quern_of"), "left").withColumn("more", F.col("quern_mark").isNotNull())
            cursor = F.col("quern_mark")
        values = cursor_values(cursor, [kinds[c] for c, _ in keys])
        rows = rows.where(cursor.isNull() | beyond_values(columns, values)).drop("quern_of", "quern_mark")
    order = [F.col(c).asc_nulls_last() if d == "ASC" else F.col(c).desc_nulls_first() for c, d in keys]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(*order)))
    rows = rows if page.first is None else rows.where(F.col("nth") <= page.first + 1)
    return rows.withColumn("cursor", cursor_of([F.col(c) for c, _ in keys]))


def _shown(page: Page, target: Label, nodes: DataFrame) -> list[str]:
    shown = nodes.columns if page.fields is None else page.fields
    bad = [c for c in shown if c not in nodes.columns]
    if bad:
        raise ValueError(f"no such field: {bad[0]}")
    return list(shown)


def connection(label: Label, name: str, page: Page, parents: DataFrame) -> DataFrame:
    """One row for each parent (a column `parent`, each once): parent and connection, a struct of edges (node, properties, cursor), pageInfo
    and, where asked for, totalCount. A parent without matches has an empty one."""
    link = label.links.get(name)
    rows = page_rows(label, name, page, parents)
    target = link.target
    properties = list(link.properties) if page.properties is None else page.properties
    rows = attached(rows, f"n_{target.key}", target, page.below)
    inner = [F.col(f"n_{c}").alias(c) for c in _shown(page, target, target.nodes)] + [F.col(f"{c}{SUFFIX}") for c in page.below]
    edge = [F.struct(*inner).alias("node"), F.struct(*(F.col(f"p_{p}").alias(p) for p in properties)).alias("properties") if properties else None, F.col("cursor")]
    edge = F.struct("nth", *(x for x in edge if x is not None)).alias("edge")
    held = rows.groupBy(F.col("parent").alias("quern_parent")).agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # of one page
    out = parents.select("parent").join(held, F.col("parent") == F.col("quern_parent"), "left")
    if isinstance(page.after, str) or page.after is None:
        out = out.withColumn("before", F.lit(page.after is not None))
    else:
        of, mark = page.after.columns[:2]
        known = page.after.where(F.col(mark).isNotNull()).select(F.col(of).alias("quern_of")).distinct()
        out = out.join(known, F.col("parent") == F.col("quern_of"), "left").withColumn("before", F.col("quern_of").isNotNull())
    every = F.coalesce("edges", F.array().cast(held.schema["edges"].dataType))
    page_edges = every if page.first is None else F.slice(every, 1, page.first) if page.first else F.slice(every, 1, 0)
    out = out.withColumn("shown", page_edges)
    information = F.struct(
        (F.size(every) > F.size("shown")).alias("hasNextPage"), F.col("before").alias("hasPreviousPage"),
        F.get("shown.cursor", F.lit(0)).alias("startCursor"), F.try_element_at("shown.cursor", F.lit(-1)).alias("endCursor"),
    )
    parts = [F.transform("shown", lambda e: e.dropFields("nth")).alias("edges"), information.alias("pageInfo")]
    if page.total:
        totals = _matches(label, name, page, parents).groupBy(F.col("parent").alias("quern_counted")).agg(F.count("*").alias("quern_total"))
        out = out.join(totals, F.col("parent") == F.col("quern_counted"), "left")
        parts.append(F.coalesce("quern_total", F.lit(0)).cast("long").alias("totalCount"))
    return out.select("parent", F.struct(*parts).alias("connection"))


def attached(rows: DataFrame, key: str, label: Label, below: dict[str, Page]) -> DataFrame:
    """rows with a column <name>Connection for each connection below the nodes whose key is in the column `key`."""
    for name, page in below.items():
        if name not in label.links:
            raise ValueError(f"no such connection: {name}")
        parents = rows.select(F.col(key).alias("parent")).where("parent is not null").distinct()
        found = connection(label, name, page, parents).select(F.col("parent").alias("quern_at"), F.col("connection").alias(f"{name}{SUFFIX}"))
        rows = rows.join(found, F.col(key) == F.col("quern_at"), "left").drop("quern_at")
    return rows


def selected(label: Label, selection: dict[str, Any] | Page) -> DataFrame:
    """The nodes of a selection with their connections: fields and <name>Connection columns, sorted where a sort is given. At the
    root `first` and `after` (one cursor) cut the sorted nodes."""
    page = selection if isinstance(selection, Page) else parsed(selection)
    rows = filtered(label, page.where)
    keys = [x for s in page.sort for x in s.items()] + [(label.key, "ASC")]
    if page.after is not None:
        kinds = dict(rows.dtypes)
        rows = rows.where(beyond_values([(F.col(c), d) for c, d in keys], cursor_values(F.lit(page.after), [kinds[c] for c, _ in keys])))
    if page.first is not None:
        rows = rows.orderBy(*sort_columns(page.sort, label.key)).limit(page.first)
    shown = _shown(page, label, label.nodes)
    rows = attached(rows, label.key, label, page.below)
    rows = rows.orderBy(*sort_columns(page.sort, label.key)) if page.sort or page.first is not None else rows
    return rows.select(*shown, *(f"{n}{SUFFIX}" for n in page.below))
