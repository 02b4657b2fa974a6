"""Helpers for lists and maps in columns; transformations whose first failure is named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """In the order of the keys."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def dedupe(a: Column) -> Column:
    """Each element once, the first places kept."""
    return F.array_distinct(a)


def map_checked(a: Column, change: Callable[[Column], Column], wrong: Callable[[Column], Column]) -> Column:
    """struct<values, error>: the changed elements, or, where `wrong` says why one of them can't be changed (else null), the first such error
    and no values."""
    error = F.get(F.filter(F.transform(a, wrong), lambda e: e.isNotNull()), F.lit(0))
    return F.struct(F.when(error.isNull(), F.transform(a, change)).alias("values"), error.alias("error"))


def map_or_fail(a: Column, change: Callable[[Column], Column], wrong: Callable[[Column], Column]) -> Column:
    """The changed elements; the first error fails the job, by its name."""
    made = map_checked(a, change, wrong)
    return F.when(made["error"].isNull(), made["values"]).otherwise(F.raise_error(made["error"]))
