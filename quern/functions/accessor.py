"""Steps into JSON values whose errors are data: a column says what went wrong instead of failing the job or giving a bare null.

    node = accessor(F.col("props")).get("a").index(0)
    df.select(node.value().alias("v"))        # struct<value: variant, error: string>

Values are VARIANT. A step into something of another type, a key that isn't there and a place out of bounds are errors; a JSON null is a value. The
first error stands whatever steps follow; with keep="last" the error of the last step stands, as each step finds nothing to go into. Text that isn't
JSON is an error of its own; a null text is a null value without an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How fields of a result's metadata are named on a page, and the one that isn't shown.
HIDDEN = ("url",)


@dataclass(frozen=True)
class Accessor:
    node: Column
    error: Column
    keep: str = "first"

    def _step(self, found: Column, wrong: Column) -> Accessor:
        """found: the value inside; wrong: why there is none, null where there is one. A value that an error left behind is null and has no type."""
        held = F.coalesce(self.error, wrong) if self.keep == "first" else F.when(self.error.isNotNull() | wrong.isNotNull(), F.coalesce(wrong, self.error))
        return replace(self, node=F.when(held.isNull(), found), error=held)

    def get(self, key: str) -> Accessor:
        inside = F.try_variant_get(self.node, "$", "map<string,variant>")
        missing = F.when(inside.isNull(), F.lit(f"cannot get value for key {key}: value is not a map")).when(~F.map_contains_key(inside, F.lit(key)), F.lit(f"cannot get value for key {key}: key not found"))
        return self._step(inside[key], missing)

    def index(self, i: int) -> Accessor:
        inside = F.try_variant_get(self.node, "$", "array<variant>")
        beyond = (F.size(inside) <= i) | F.lit(i < 0)
        missing = F.when(inside.isNull(), F.lit(f"cannot get value for index {i}: value is not an array")).when(beyond, F.lit(f"cannot get value for index {i}: index out of bounds"))
        return self._step(F.get(inside, F.lit(max(i, 0))), missing)

    def value(self) -> Column:
        """struct<value: variant, error: string>."""
        return F.struct(self.node.alias("value"), self.error.alias("error"))

    def _as(self, kind: str, what: str) -> Column:
        inside = F.try_variant_get(self.node, "$", kind)
        error = F.coalesce(self.error, F.when(inside.isNull(), F.lit(f"value is not {what}")))
        return F.struct(inside.alias("value"), error.alias("error"))

    def as_map(self) -> Column:
        """struct<value: map<string, variant>, error: string>."""
        return self._as("map<string,variant>", "a map")

    def as_array(self) -> Column:
        """struct<value: array<variant>, error: string>."""
        return self._as("array<variant>", "an array")


def accessor(source: Column, keep: str = "first", parsed: bool = False) -> Accessor:
    """source: JSON text, or a variant if `parsed`."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep: {keep}")
    if parsed:
        return Accessor(source, F.lit(None).cast("string"), keep)
    node = F.try_parse_json(source)
    return Accessor(node, F.when(source.isNotNull() & node.isNull(), F.lit("not JSON")), keep)


def shown_values(values: Column, hidden: tuple[str, ...] = HIDDEN) -> Column:
    """Of a map from names to variants those that are shown: null and '' aren't, 0 and false are, nor are hidden names."""
    text = lambda v: F.try_variant_get(v, "$", "string")
    return F.map_filter(values, lambda k, v: ~k.isin(*hidden) & v.isNotNull() & ~F.is_variant_null(v) & (text(v) != ""))


def named_values(row: Column) -> Column:
    """The fields of a struct as a map from names to variants; fields that are null are JSON nulls."""
    return F.try_variant_get(F.parse_json(F.to_json(row, {"ignoreNullFields": "false"})), "$", "map<string,variant>")
