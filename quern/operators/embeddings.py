"""Embedding targets and a pluggable embedder.

An embedder is any object with embed_batch(texts) -> list of vectors; it travels to the executors, so it must pickle.
Batches run in tasks, each with a bounded number of calls under way. A batch that fails is tried again one text at a time;
a text that fails gets no vector and an error, and the run goes on.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase_text, truncate
from .calls import ordered_calls, task_count

BATCH, TEXT_LENGTH, PHRASES, SALTS = 32, 2000, 20, 32


class Embedder(Protocol):
    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class HttpEmbedder:
    """One POST for each batch to an /api/embed endpoint; vectors are positional."""

    def __init__(self, url: str, model: str, timeout: float = 60.0):
        if not url or not model:
            raise ValueError("url and model are needed")
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            vectors = json.load(reply).get("embeddings") or []
        if len(vectors) != len(texts) or not all(vectors):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors

    def embed_text(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


def targets(nodes: DataFrame, text: str = "text", field: str = "embedding") -> DataFrame:
    """id and text of nodes that have no vector yet and some text."""
    return nodes.where(F.col(field).isNull() & (F.coalesce(F.col(text), F.lit("")) != "")).select("id", F.col(text).alias("text"))


def named_targets(nodes: DataFrame, phrases: DataFrame, field: str = "embedding", most: int = PHRASES) -> DataFrame:
    """id and "name. phrase; phrase" of nodes without a vector. phrases: src_id, pos, phrase; empty ones don't count.

    Only the first `most` of a node are gathered: they are ranked by (node, salt) first, then by node.
    """
    real = phrases.where("coalesce(phrase, '') <> ''").withColumn("salt", F.pmod(F.xxhash64("pos", "phrase"), F.lit(SALTS)))
    for keys in (["src_id", "salt"], ["src_id"]):  # the first of each salt, so that no task ranks all phrases of a node
        order = Window.partitionBy(*keys).orderBy("pos", "phrase")
        real = real.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    some = real.groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct("pos", "phrase"))).alias("p"))
    joined = nodes.where(F.col(field).isNull()).join(some, F.col("id") == F.col("src_id"), "left")
    return joined.select("id", phrase_text(F.col("name"), F.coalesce(F.col("p.phrase"), F.array().cast("array<string>")), most).alias("text")).where("text <> ''")


def embed(rows: DataFrame, embedder: Embedder, batch: int = BATCH, most: int = TEXT_LENGTH, concurrency: int | None = None, in_flight: int = 1, cluster_limit: int | None = None) -> DataFrame:
    """id, embedding, error of each target.

    concurrency: how many tasks call; in_flight: batches that a task has under way at a time; cluster_limit: batches that all tasks may
    have under way together, from which the number of tasks follows. Results keep the order of the rows in a task. A batch that fails is tried
    again one text at a time, in its own place, so it takes no further call from the limit.
    """
    if cluster_limit is not None:
        concurrency = task_count(cluster_limit, in_flight)
    if concurrency:
        rows = rows.repartition(concurrency)
    rows = rows.select("id", truncate(F.col("text"), most).alias("text"))

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            made = embedder.embed_batch([text])
            return (made[0], None) if len(made) == 1 and made[0] else (None, "no vector")
        except Exception as e:
            return None, str(e)

    def many(part: tuple[list, list[str]]) -> list[tuple]:
        ids, texts = part
        try:
            made = embedder.embed_batch(texts)
            out = [(v, None) for v in made] if len(made) == len(texts) else [(None, "wrong number of vectors")] * len(texts)
        except Exception:
            out = [one(t) for t in texts]
        return [(i, v, e) for i, (v, e) in zip(ids, out, strict=True)]

    def parts(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        for records in source:
            ids, texts = records.column("id").to_pylist(), records.column("text").to_pylist()
            for k in range(0, len(texts), batch):
                yield ids[k : k + batch], texts[k : k + batch]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in ordered_calls(parts(source), many, in_flight):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in done]), pa.array([v for _, v, _ in done], pa.list_(pa.float32())), pa.array([e for _, _, e in done], pa.string())], ["id", "embedding", "error"])

    return rows.mapInArrow(run, "id string, embedding array<float>, error string")
