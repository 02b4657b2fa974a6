"""A stored index of vectors: cells around centroids, so that a search reads the cells near the query and no others.

`build` fits centroids (spherical k-means) on a bounded sample of rows, chosen by the hash of their id; every row is then assigned to its nearest
centroid and stored in the folder of that cell. `search` compares a query with the centroids, takes its `probes` nearest cells and reads only
their folders (partition pruning), for all queries of a block in one scan. How many cells to probe is measured when the index is built: sampled queries
are answered exactly, and the least number with which they find RECALL of their neighbours is kept with the centroids. `probes="all"` is exact.

Bounds: the sample (SAMPLE rows), the centroids (MOST_CELLS) and a block of queries are what the driver holds and broadcasts. A cell that holds a third of
all rows is written as several files by Spark's rebalancing, and read by several tasks.

Distances are cosine distances in double precision; ties go to the smaller id. Rows without a vector, without components or of length zero aren't
indexed; a query of length zero finds nothing; vectors of another length than the index has are an error. `add` puts further rows into the cells as they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Files
from .search import arrow_kind, nearest_by_group

SAMPLE, MOST_CELLS, ROUNDS, SEED = 20_000, 4096, 12, 11
ASKED, RECALL, PER_GROUP = 64, 0.95, 10
QUERY_BLOCK = 1024


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centroids_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids; an empty cell takes the row that is farthest from its own."""
    sample = _unit(sample.astype(np.float64))
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 2000] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 2000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        lost = np.flatnonzero(lengths == 0)
        if len(lost):
            far = np.argsort((sample * centres[near]).sum(axis=1))[: len(lost)]
            sums[lost[: len(far)]], lengths[lost[: len(far)]] = sample[far], 1.0
        good = lengths > 0
        centres[good] = sums[good] / lengths[good, None]
    return centres


def _vectors(batch: pa.RecordBatch, name: str, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector with length, these vectors)."""
    lists = batch.column(name)
    sizes = np.array([len(v) if v is not None else 0 for v in (x.values for x in lists)], np.int64)
    have = np.flatnonzero(sizes)
    if width is not None and (sizes[have] != width).any():
        raise ValueError("vectors of different lengths")
    if not len(have):
        return have, np.zeros((0, width or 0))
    data = np.stack([lists[int(i)].values.to_numpy(zero_copy_only=False) for i in have]).astype(np.float64)
    real = np.isfinite(data).all(axis=1) & (data != 0).any(axis=1)
    return have[real], data[real]


def _assign(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in source:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, data = _vectors(part, "embedding", centres.shape[1])
                if len(rows):
                    cell = (_unit(data) @ centres.T).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, pa.array(cell)], [*part.schema.names, "cell"])

    return run


class VectorIndex:
    """An index in a folder: `rows` (id, grp, embedding, by cell), `centroids` and `about.json`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.about = json.loads(Files(spark, root).read(f"{self.root}/about.json"))
        held = spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres = np.array([r["centroid"] for r in held]) if held else np.zeros((0, 0))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.about["schema"]).option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows")

    def add(self, nodes: DataFrame, key: str = "id", group: str = "entity_type", field: str = "embedding") -> None:
        """Further rows, assigned to the cells as they are."""
        _write(self.spark, self.root, nodes.select(F.col(key).alias("id"), F.col(group).alias("grp"), F.col(field).alias("embedding")), self.centres)

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector all cells, nearest first."""
        return np.argsort(-(_unit(vectors) @ self.centres.T), axis=1, kind="stable")

    def search(self, queries: DataFrame, k: int = PER_GROUP, probes: int | str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """query_id, grp, id, distance of the k nearest rows of each group in the probed cells. queries: query_id, vector, a stated set.
        probes: how many cells, or "all"; by default the number that was measured."""
        if k <= 0:
            raise ValueError("k must be positive")
        wanted = len(self.centres) if probes == "all" else int(probes or self.about["probes"])
        kinds = dict(self.rows().dtypes)
        given = {"query_id": dict(queries.dtypes)["query_id"], "grp": kinds["grp"], "id": kinds["id"]}
        schema = ", ".join(f"{c} {arrow_kind(t)}" for c, t in given.items()) + ", distance double"
        found, held = [], []
        for r in queries.select("query_id", "vector").toLocalIterator():
            held.append((r["query_id"], np.asarray(r["vector"], np.float64)))
            if len(held) == block:
                found.append(self._block(held, k, wanted, schema))
                held = []
        if held:
            found.append(self._block(held, k, wanted, schema))
        found = [f for f in found if f is not None]
        out = found[0] if found else self.spark.createDataFrame([], schema)
        for f in found[1:]:
            out = out.unionByName(f)
        out = out.select(*(F.col(c).cast(t).alias(c) for c, t in given.items()), "distance")
        order = Window.partitionBy("query_id", "grp").orderBy("distance", "id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")

    def _block(self, held: list, k: int, probes: int, schema: str) -> DataFrame | None:
        held = [(i, v) for i, v in held if len(v) and np.isfinite(v).all() and v.any()]
        if not held or not len(self.centres):
            return None
        if any(len(v) != self.centres.shape[1] for _, v in held):
            raise ValueError("vectors of different lengths")
        matrix = _unit(np.stack([v for _, v in held]))
        near = self.cells_of(matrix)[:, :probes]
        asked: dict[int, list[int]] = {}
        for q, cells in enumerate(near.tolist()):
            for c in cells:
                asked.setdefault(c, []).append(q)
        rows = self.rows()
        if len(asked) < len(self.centres):
            rows = rows.where(F.col("cell").isin(sorted(asked)))  # folders that no query probes aren't listed for reading
        shared = self.spark.sparkContext.broadcast(([i for i, _ in held], matrix, asked))
        return rows.select("cell", "id", "grp", "embedding").mapInArrow(_match(shared, k), schema)


def _match(shared, k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, asked = shared.value
        best: dict = {}
        for batch in source:
            rows, data = _vectors(batch, "embedding", matrix.shape[1])
            if not len(rows):
                continue
            data = _unit(data)
            cells = batch.column("cell").to_numpy()[rows]
            keys = np.array(batch.column("id").to_pylist(), object)[rows]
            groups = np.array(batch.column("grp").to_pylist(), object)[rows]
            for c, g in {(c, g) for c, g in zip(cells.tolist(), groups.tolist(), strict=True)}:
                own, queries = np.flatnonzero((cells == c) & (groups == g)), asked.get(c, [])
                distance = 1 - matrix[queries] @ data[own].T
                for q, row in zip(queries, distance, strict=True):
                    last = np.partition(row, min(k, len(own)) - 1)[min(k, len(own)) - 1]
                    near = np.flatnonzero(row <= last)  # the k nearest, and ties
                    best[q, g] = sorted(best.get((q, g), []) + list(zip(row[near].tolist(), keys[own[near]].tolist(), strict=True)))[:k]
        if best:
            yield pa.RecordBatch.from_pylist([{"query_id": ids[q], "grp": g, "id": i, "distance": d} for (q, g), rows in best.items() for d, i in rows])

    return run


def _write(spark: SparkSession, root: str, nodes: DataFrame, centres: np.ndarray) -> None:
    kinds = dict(nodes.dtypes)
    shared = spark.sparkContext.broadcast(centres)
    placed = nodes.mapInArrow(_assign(shared), f"id {kinds['id']}, grp {kinds['grp']}, embedding {kinds['embedding']}, cell int")
    placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{root}/rows")  # large cells in several files, small ones together


def build(nodes: DataFrame, root: str, key: str = "id", group: str = "entity_type", field: str = "embedding", cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = PER_GROUP) -> VectorIndex:
    """The index of a table, written to a new folder `root`. cells: by default the root of the number of rows, at most MOST_CELLS and an eighth
    of the sample."""
    spark, root = nodes.sparkSession, root.rstrip("/")
    rows = nodes.select(F.col(key).alias("id"), F.col(group).alias("grp"), F.col(field).alias("embedding")).where("id is not null and size(embedding) > 0")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "embedding").collect()  # bounded by the parameter
    some = [(r["id"], np.asarray(r["embedding"], np.float64)) for r in some if None not in r["embedding"]]
    some = [(i, v) for i, v in some if np.isfinite(v).all() and v.any()]
    if len({len(v) for _, v in some}) > 1:
        raise ValueError("vectors of different lengths")
    wanted = cells or max(1, min(MOST_CELLS, math.isqrt(rows.count()), len(some) // 8))
    centres = centroids_of(np.stack([v for _, v in some]), min(wanted, len(some))) if some else np.zeros((0, 0))
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, grp {kinds['grp']}, embedding {kinds['embedding']}, cell int"
    if some:
        _write(spark, root, rows, centres)
    else:
        spark.createDataFrame([], schema).write.parquet(f"{root}/rows")
    spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cell int, centroid array<double>").write.parquet(f"{root}/centroids")
    files = Files(spark, root)
    files.publish(f"{root}/about.json", json.dumps({"schema": schema, "probes": len(centres)}))
    index = VectorIndex(spark, root)
    if len(centres) > 1:
        probes = _measured(index, some[:ASKED], recall, k)
        files.delete(f"{root}/about.json")
        files.publish(f"{root}/about.json", json.dumps({"schema": schema, "probes": probes, "recall": recall, "k": k}))
        index = VectorIndex(spark, root)
    return index


def _measured(index: VectorIndex, some: list[tuple], recall: float, k: int) -> int:
    """The least number of cells in which sampled queries find so much of what an exact search finds."""
    asked = index.spark.createDataFrame([(i, v.tolist()) for i, (_, v) in enumerate(some)], "query_id int, vector array<double>")
    exact = nearest_by_group(index.rows(), asked, k, "grp", "id").select("query_id", F.col("id").alias("near")).distinct()
    cells = index.rows().select("id", "cell").join(F.broadcast(exact), F.col("id") == F.col("near")).select("query_id", "cell").collect()  # at most ASKED x groups x k
    place = np.argsort(index.cells_of(np.stack([v for _, v in some])), axis=1)  # of each cell in the order of each query
    order = np.sort([place[r["query_id"], r["cell"]] for r in cells])
    return int(order[max(0, math.ceil(recall * len(order)) - 1)]) + 1 if len(order) else len(index.centres)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, grp, id) that were found."""
    on = ["query_id", "grp", "id"]
    both = exact.select(*on).join(found.select(*on), on, "left_semi").count()
    return both / max(1, exact.count())
