"""Sorting and keyset pagination of node queries."""

from __future__ import annotations

import base64
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Label, filtered


def sort_columns(sort: list[dict[str, str]], key: str) -> list[Column]:
    """Nulls come last when ascending and first when descending; the key breaks ties."""
    out = []
    for field, direction in (x for s in sort for x in s.items()):
        if direction not in ("ASC", "DESC"):
            raise ValueError(f"direction of {field}: {direction}")
        out.append(F.col(field).asc_nulls_last() if direction == "ASC" else F.col(field).desc_nulls_first())
    return [*out, F.col(key).asc()]


def encode_cursor(values: list[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode()


def decode_cursor(cursor: str) -> list[Any]:
    try:
        return json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("not a cursor") from e


def beyond(sort: list[tuple[str, str]], values: list[Any]) -> Column:
    """Rows after the given sort values, in the order of sort_columns."""
    options, same = [], []
    for (field, direction), v in zip(sort, values, strict=True):
        c = F.col(field)
        if direction == "ASC":
            after = F.lit(False) if v is None else (c > F.lit(v)) | c.isNull()
        else:
            after = c.isNotNull() if v is None else c < F.lit(v)
        options.append(reduce(lambda a, b: a & b, same, after))
        same.append(c.isNull() if v is None else c == F.lit(v))
    return reduce(lambda a, b: a | b, options)


def list_nodes(label: Label, where: dict | None = None, sort: list[dict[str, str]] | None = None) -> DataFrame:
    rows = filtered(label, where)
    return rows.orderBy(*sort_columns(sort, label.key)) if sort else rows


class Connection:
    """A page: rows with their cursor, page information and the count of all matches."""

    def __init__(self, label: Label, first: int, after: str | None = None, where: dict | None = None, sort: list[dict[str, str]] | None = None):
        if first < 0:
            raise ValueError("first must not be negative")
        self.keys = [x for s in sort or [] for x in s.items()] + [(label.key, "ASC")]
        self.matches = filtered(label, where)
        rows = self.matches.where(beyond(self.keys, decode_cursor(after))) if after else self.matches
        self.first, self.after = first, after
        self.page = rows.orderBy(*sort_columns(sort or [], label.key)).limit(first + 1)

    def total_count(self) -> int:
        return self.matches.count()

    def edges(self) -> tuple[list[dict], dict]:
        """(node and cursor of each row, page information); at most first + 1 rows reach the driver."""
        rows = self.page.collect()
        shown = [{"node": r.asDict(), "cursor": encode_cursor([r[k] for k, _ in self.keys])} for r in rows[: self.first]]
        return shown, {
            "hasNextPage": len(rows) > self.first,
            "hasPreviousPage": self.after is not None,
            "startCursor": shown[0]["cursor"] if shown else None,
            "endCursor": shown[-1]["cursor"] if shown else None,
        }
