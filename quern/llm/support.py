"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local master gets a temporary folder; on a cluster there is no safe default.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stash(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there.

    An executor may be lost later without any of df being computed again. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def runs(parts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about `limit` bytes; a larger part stands alone, whole."""
    lo = size = 0
    for i, part in enumerate(parts):
        if size and size + len(part) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(part)
    if lo < len(parts):
        yield lo, len(parts)


def slices(source: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most `rows` rows, so that fewer texts are Python objects at a time."""
    for batch in source:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def cut_at(text: bytes, word: re.Pattern, limit: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `limit` bytes, none of which ends within a word; most texts are one part."""
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text) and (over := word.match(text, end)):  # the word that stands there goes on
            end = over.end()
        yield text[at:end] if at or end < len(text) else text
        at = end


def released(run: Callable) -> Callable:
    """A function for mapInArrow whose worker gives back, when a task ends, the memory that its allocators keep: workers wait for further
    tasks, and several of them stand beside the JVM in an executor's memory."""

    def wrapped(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped
