"""Incremental embedding: nodes that arrive as a stream get vectors batch by batch.

Each micro-batch is a plain table, so the batch operators apply; nodes that already have a vector, or no text, pass by.
A batch is written under its own number, so one that runs again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.embeddings import Embedder, embed, targets


def node_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def backfill(nodes: DataFrame, embedder: Embedder, out: str, checkpoint: str, text: str = "text", field: str = "embedding") -> StreamingQuery:
    """Writes id, embedding and error of each node without a vector to <out>/batch=<n>; ends when the input is used up."""

    def step(batch: DataFrame, number: int) -> None:
        embed(targets(batch, text, field), embedder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return nodes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
