"""Readers of the source tree: chapter files, optional study files, map-shaped JSON."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) is there, in any file system that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return bool(found)


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """<root>/<volume>/<slug>/<number>.json: the file's fields, volume, slug and file_number (0 if the name isn't a number).

    A malformed file fails the read.
    """
    if not exists(spark, f"{root}/*/*/*.json"):
        return spark.createDataFrame([], schemas.CHAPTER_FILE).select("*", F.lit("").alias("volume"), F.lit("").alias("slug"), F.lit(0).alias("file_number"))
    rows = spark.read.schema(schemas.CHAPTER_FILE).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/*/*.json")
    path = F.split(F.col("_metadata.file_path"), "/")
    name = F.regexp_extract(F.element_at(path, -1), r"^([0-9]+)\.json$", 1)
    return rows.select("*", F.element_at(path, -3).alias("volume"), F.element_at(path, -2).alias("slug"), F.coalesce(name.try_cast("int"), F.lit(0)).alias("file_number"))


def read_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """name, pos, value of a JSON file whose root is a map from names; empty when the file is missing, an error when it is malformed."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"name string, value {kind}, pos int").select("name", "pos", "value")
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,{kind}>", {"mode": "FAILFAST"})
    entries = text.select(F.posexplode(F.map_entries(parsed)).alias("pos", "e"))
    return entries.select("e.key", "pos", "e.value").withColumnRenamed("key", "name")


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of a JSON file whose root is a list, with their place as pos."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("pos", F.lit(0)).limit(0)
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return text.select(F.posexplode(parsed).alias("pos", "e")).select("e.*", "pos")



def read_config(given: dict[str, str] | None = None, required: tuple[str, ...] = ("DATA_DIR",)) -> dict[str, str]:
    """Settings from the environment, overridden by `given`; ENV must be development or production."""
    out = dict(os.environ) | (given or {})
    if out.get("ENV") not in ("development", "production"):
        raise ValueError("ENV must be development or production")
    missing = [k for k in required if not out.get(k)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
