"""Row-count windows over ordered rows, and growing conversation histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, STEP = 5, 3


def sliding_groups(rows: DataFrame, keys: list[str], order: str, text: str, size: int = SIZE, step: int = STEP, separator: str = " ") -> DataFrame:
    """Windows of `size` rows that start every `step` rows of a group, until one reaches its end; the last may be short.

    keys, first and last (values of `order`), n_rows, text (joined in order). Rows are numbered once for each group and each
    goes to the at most ceil(size / step) windows that hold it, so a window is one small group.
    """
    if not 0 < step <= size:
        raise ValueError("a window must be at least as long as its step")
    by = Window.partitionBy(*keys)
    numbered = rows.select(*keys, F.col(order).alias("pos"), F.coalesce(F.col(text), F.lit("")).alias("part"))
    numbered = numbered.withColumn("i", F.row_number().over(by.orderBy("pos")) - 1).withColumn("n", F.count("*").over(by))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (size - 1)) / step).cast("int"))
    starts = F.transform(F.sequence(low, F.floor(F.col("i") / step).cast("int")), lambda k: k * step)
    valid = F.filter(F.when(low * step <= F.col("i"), starts), lambda s: (s == 0) | (s - step + size < F.col("n")))
    dealt = numbered.select(*keys, "pos", "part", "i", F.explode(valid).alias("start"))
    grouped = dealt.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("i", "pos", "part"))).alias("w"))
    return grouped.select(
        *keys, F.get("w.pos", F.lit(0)).alias("first"), F.element_at("w.pos", -1).alias("last"), F.size("w").alias("n_rows"), F.array_join("w.part", separator).alias("text")
    )


def history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What each user turn sends: all turns up to it, as (role, text) in order."""
    so_far = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = F.collect_list(F.struct("role", "text")).over(so_far)
    return turns.withColumn("sent", sent).where("role = 'user'").select(conversation, turn, "sent", F.size("sent").alias("n_sent"))


def carry_forward(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Each null of the column becomes the last value before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
