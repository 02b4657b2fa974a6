"""Joins of citations with nodes: inner with rejects, left for range ends, first-only, range expansion, pair deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of pairs of equal keys: values that travel as one list, targets and sources of a block, shares that meet each other, keys that are dealt out in shares.
LIST, TARGETS, SOURCES, SHARES, MOST_COMMON = 1024, 128, 32, 4, 10_000


def sorted_side(rows: DataFrame) -> DataFrame:
    """A side that grows with the tables, and isn't broadcast because its compressed file is small: names and verses take many times that in memory."""
    return rows.hint("merge")


def lookup(rows: DataFrame, dimension: DataFrame, on: Column, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's key as `name`, rows without a match)."""
    dimension = sorted_side(dimension)
    found = rows.join(dimension, on).select(*rows.columns, F.col(key).alias(name))
    return found, rows.join(dimension, on, "left_anti")


def with_range_end(rows: DataFrame, verses: DataFrame, name: str = "targetEndVerseId") -> DataFrame:
    """The id of the verse at end_verse, empty when there is none."""
    ends = verses.select(*(F.col(c).alias(f"end_{c}") for c in ("volume", "slug", "chapter")), F.col("number").alias("end_number"), F.col("id").alias(name))
    on = (F.col("volume") == F.col("end_volume")) & (F.col("slug") == F.col("end_slug")) & (F.col("chapter") == F.col("end_chapter")) & (F.col("end_verse") == F.col("end_number"))
    return rows.join(sorted_side(ends), on & (F.col("end_verse") > 0), "left").select(*rows.columns, F.coalesce(name, F.lit("")).alias(name))


def first_match(rows: DataFrame, dimension: DataFrame, on: Column, row_key: list[str], order: str, key: str, name: str) -> DataFrame:
    """Of several matches the one that comes first in the dimension's order."""
    w = Window.partitionBy(*row_key).orderBy(order, key)
    found = rows.join(sorted_side(dimension), on).withColumn("quern_nth", F.row_number().over(w)).where("quern_nth = 1")
    return found.select(*rows.columns, F.col(key).alias(name))


def expand_range(rows: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row for each number from first to last; an absent or smaller last counts as first."""
    upper = F.greatest(F.col(first), F.coalesce(F.col(last), F.col(first)))
    return rows.withColumn(name, F.explode(F.sequence(F.col(first), upper)))


def first_of_pairs(rows: DataFrame, order: list[str], source: str = "src_id", target: str = "dst_id") -> DataFrame:
    """Each (source, target) once, the row that comes first."""
    w = Window.partitionBy(source, target).orderBy(*order)
    return rows.withColumn("quern_nth", F.row_number().over(w)).where("quern_nth = 1").drop("quern_nth")


def pairs_of_equal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(src_id, dst_id): the pairs of different values of each two rows of one key, as many as there are.

    Values travel in lists of about LIST, without their rows. A common key (more than TARGETS rows, or than a MOST_COMMON-th of the table) is dealt out in up
    to SHARES shares that meet each other, so it is the work of SHARES * SHARES cells, and a value is sent 2 * SHARES times at most. In a cell small blocks
    of targets and sources meet; a task holds the pairs of a block of targets with its cell. Their order keeps columnar files small: a source stays for TARGETS rows, and the same
    TARGETS targets follow again and again; in the order of a plain join a cycle of targets is as long as the key has rows, and files don't compress.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("of"), F.col(value).alias("value"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    common = rows.groupBy("of").agg(F.count("*").alias("n")).join(total, F.col("n") > F.greatest(F.lit(TARGETS), F.col("total") / MOST_COMMON))
    shares = F.least(F.lit(SHARES), F.ceil(F.col("n") / TARGETS)).cast("int").alias("shares")
    common = F.broadcast(common.select(F.col("of").alias("common"), shares, F.ceil(F.col("n") / LIST).cast("int").alias("lists")))
    shares = F.coalesce("shares", F.lit(1))
    nth = F.pmod(F.xxhash64("value"), F.greatest(shares, "lists")).cast("int")
    lists = rows.join(common, F.col("of") == F.col("common"), "left").groupBy("of", shares.alias("shares"), nth.alias("nth")).agg(F.collect_list("value").alias("values"))
    share, each = F.col("nth") % F.col("shares"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    tasks = 16 * rows.sparkSession.sparkContext.defaultParallelism

    def blocks(i: Column, j: Column, size: int, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.size("values"), F.lit(size)), lambda at: F.slice("values", at, size))
        return lists.select("of", i.alias("i"), j.alias("j"), "values").repartition(tasks, "of", "i", "j").select("of", "i", "j", F.explode(cut).alias(name))

    met = sorted_side(blocks(each, share, TARGETS, "targets")).join(blocks(share, each, SOURCES, "sources"), ["of", "i", "j"])
    return met.select(F.explode("sources").alias("src_id"), "targets").select("src_id", F.explode("targets").alias("dst_id")).where("src_id <> dst_id")


def split_categories(rows: DataFrame, column: str = "category", name: str = "kind") -> DataFrame:
    """A row for each category of a comma-separated list."""
    parts = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(name, F.explode(F.array_distinct(parts)))
