"""Approximate nearest neighbours by inner product: a forest of hash prefixes.

1. Equal vectors become one entry with its k + 1 smallest ids: a query never needs more of them, so a vector that a third of all rows
   share is one point. Tasks combine their own rows first.
2. Each of TREES trees gives an entry a label of BITS bits, the sides of random hyperplanes. For inner products the entries get one more
   coordinate that brings all to the greatest length; queries have a zero there, so angles order entries as products do.
3. A tree is a sorted array of labels. It is dealt out by the first bits into cells of about CELL entries (a larger cell in parts). In a cell a
   query descends by binary search to its longest common prefix, and the entries that share at least x bits are a range of the array; their
   number is counted for every x, and for the first bits from the counts of cells.
4. All trees ascend together: a query's level is the greatest x at which the trees hold at least `wanted` entries in total. `wanted` is measured:
   SAMPLE queries are answered exactly, and of the numbers met on their ascents the least one that gives them a recall of RECALL is taken.
5. Every query visits the cells that its prefix of that level covers, scores the ranges there in double precision, and passes its k + 1 best on.

Cells bound what a task holds: parts of entries and blocks of queries meet one by one. Only the sample (at most SAMPLE queries with their
k + 1 neighbours) comes to the driver. Recall against brute force is in the README and tested.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors meet those of
equal length only; rows that share id and vector count as one row, and a query is never its own neighbour, not by another row of its id either;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import stash

K, TREES, BITS, SEED = 20, 8, 60, 7
#: Entries of a cell, queries that meet them at once, scores held at a time.
CELL, QUERIES, SCORES = 8192, 4096, 1 << 22
SAMPLE, RECALL = 64, 0.96
#: Entries that a task combines before it hands them on; parts in which the rows of one vector are combined again.
HELD, SPREAD = 20_000, 32


def _points(batch: pa.RecordBatch, single: bool) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(id, is it a query, vector) of the rows that take part."""
    for key, queried, vector in zip(batch.column("id").to_pylist(), batch.column("queried").to_pylist(), batch.column("vec"), strict=True):
        values = vector.values
        if key is None or values is None or not len(values) or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8", copy=False)
        if np.isfinite(x).all() and x.any():
            yield key, bool(queried), x


def _combine(single: bool, k: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def made() -> pa.RecordBatch:
            columns = [pa.array([hashlib.md5(v).digest() for v in held], pa.binary()), pa.array(list(held), pa.binary())]
            columns += [pa.array([x[0] for x in held.values()], pa.list_(pa.int64())), pa.array([x[1] for x in held.values()], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["entry", "vec", "ids", "queried"])

        for batch in source:
            for key, queried, x in _points(batch, single):
                own = held.setdefault(x.tobytes(), [[], False])
                own[1] |= queried
                if key not in own[0]:
                    own[0] = sorted([*own[0], key])[: k + 1]
                if len(held) >= HELD:
                    yield made()
                    held.clear()
        if held:
            yield made()

    return run


def _asked(single: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [(key, hashlib.md5(x.tobytes()).digest()) for key, queried, x in _points(batch, single) if queried]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary())], ["query_id", "entry"])

    return run


def _array(raw: bytes, single: bool) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if single else "<f8").astype(np.float64)


@lru_cache(maxsize=4)
def _planes(width: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width + 1, trees * BITS))


def _labels(points: np.ndarray, extra: np.ndarray, trees: int) -> np.ndarray:
    """For each point its label in each tree; extra: the last coordinate."""
    planes = _planes(points.shape[1], trees)
    sides = (points @ planes[:-1] + extra[:, None] * planes[-1] > 0).reshape(len(points), trees, BITS)
    return sides.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _labelled(single: bool, trees: int):
    """Adds labels (as an entry) and asked (as a query; null for entries that aren't queries)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                raw, longest = part.column("vec").to_pylist(), part.column("longest").to_numpy()
                labels, asked = [None] * len(raw), [None] * len(raw)
                queried = part.column("queried").to_pylist()
                for size in {len(v) for v in raw}:
                    own = [i for i, v in enumerate(raw) if len(v) == size]
                    points = np.stack([_array(raw[i], single) for i in own])
                    rest = np.sqrt(np.maximum(longest[own] ** 2 - (points * points).sum(axis=1), 0))
                    for i, entry, query in zip(own, _labels(points, rest, trees), _labels(points, np.zeros(len(own)), trees), strict=True):
                        labels[i], asked[i] = entry, query if queried[i] else None
                yield pa.RecordBatch.from_arrays(
                    [part.column("entry"), part.column("vec"), part.column("ids"), part.column("dim"), pa.array(labels, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64()))],
                    ["entry", "vec", "ids", "dim", "labels", "asked"],
                )

    return run


def _lengths(single: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            best: dict[int, float] = {}
            for raw in batch.column("vec").to_pylist():
                best[len(raw)] = max(best.get(len(raw), 0.0), float(np.linalg.norm(_array(raw, single))))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["dim", "longest"])

    return run


def entries_of(vectors: DataFrame, single: bool, k: int = K, trees: int = TREES) -> DataFrame:
    """vectors: id, vec, queried. entry (md5 of the vector), vec, ids (the k + 1 smallest), dim (its bytes), labels, asked."""
    parts = vectors.mapInArrow(_combine(single, k), "entry binary, vec binary, ids array<long>, queried boolean").withColumn("part", F.spark_partition_id() % SPREAD)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    for by in (["entry", "part"], ["entry"]):
        parts = parts.groupBy(*by).agg(F.first("vec").alias("vec"), least, F.max("queried").alias("queried"))
    entries = stash(parts.withColumn("dim", F.octet_length("vec")), "vectors")
    longest = entries.select("vec").mapInArrow(_lengths(single), "dim int, longest double").groupBy(F.col("dim").alias("of_dim")).agg(F.max("longest").alias("longest"))
    sized = entries.join(longest, F.col("dim") == F.col("of_dim")).drop("of_dim")
    return stash(sized.mapInArrow(_labelled(single, trees), "entry binary, vec binary, ids array<long>, dim int, labels array<long>, asked array<long>"), "forest")


def _in_trees(forest: DataFrame, labels: str, bits: int, *more: str) -> DataFrame:
    """tree, cell and label of each entry in each tree. Vectors of other lengths have other trees."""
    rows = forest.where(F.col(labels).isNotNull()).select("entry", "dim", *more, F.posexplode(labels).alias("nth", "label"))
    return rows.select(F.struct("dim", "nth").alias("tree"), F.shiftright("label", BITS - bits).alias("cell"), "label", "entry", *more)


def _part_of(parts: str) -> Column:
    return F.pmod(F.xxhash64("entry"), F.col(parts).cast("long")).cast("int")


def _numbers(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _ranges(labels: np.ndarray, asked: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """In sorted labels, where those begin and end that share the first `level` bits."""
    rest = np.int64(BITS) - level
    first = (asked >> rest) << rest
    return np.searchsorted(labels, first, "left"), np.searchsorted(labels, first + (np.int64(1) << rest) - 1, "right")


def _descend(bits: int):
    def run(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """For each query and level the number of entries of the cell that share so many bits."""
        labels, asked = np.sort(cell["label"].to_numpy()), queries["label"].to_numpy()
        out = []
        for level in range(bits, BITS + 1):
            lo, hi = _ranges(labels, asked, level)
            met = np.flatnonzero(hi > lo)
            if not len(met):
                break
            out.append(pd.DataFrame({"entry": queries["entry"].to_numpy()[met], "level": level, "n": (hi - lo)[met]}))
        return pd.concat(out) if out else pd.DataFrame({"entry": [], "level": [], "n": []})

    return run


def _met(data: DataFrame, visits: DataFrame, cells: DataFrame):
    """Groups of a part of a cell's entries and a block of the queries that visit it; cells that nobody visits are left out."""
    at, group = ["tree", "cell"], ["tree", "cell", "part", "block"]
    numbers = visits.groupBy(*at).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    numbers = stash(cells.select(*at, "parts").join(numbers, at), "visited")
    data = data.join(numbers, at).withColumn("part", _part_of("parts")).withColumn("block", _numbers("blocks"))
    visits = visits.join(numbers, at).withColumn("block", _part_of("blocks")).withColumn("part", _numbers("parts")).drop("parts", "blocks")
    visits = visits.select(*(F.col(c).alias(c) for c in visits.columns))  # both come from the same rows: other attributes on this side
    return data.drop("parts", "blocks").groupBy(*group).cogroup(visits.groupBy(*group))


def ascents(forest: DataFrame, bits: int, cells: DataFrame) -> DataFrame:
    """entry, level, n: how many entries all trees together hold that share at least `level` bits with the query."""
    asked = stash(_in_trees(forest.select("entry", "dim", "asked"), "asked", bits), "asked")
    data = _in_trees(forest.select("entry", "dim", "labels"), "labels", bits)
    deep = _met(data, asked, cells).applyInPandas(_descend(bits), "entry binary, level int, n long")
    if bits:
        levels = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
        prefix = F.expr(f"shiftright(cell, {bits} - level)").alias("prefix")
        above = cells.select("tree", "cell", "n", levels).groupBy("tree", "level", prefix).agg(F.sum("n").alias("n"))
        begun = asked.select("tree", "cell", "entry", levels).select("tree", "level", prefix, "entry")
        deep = deep.unionByName(begun.join(above, ["tree", "level", "prefix"]).select("entry", "level", "n"))
    return stash(deep.groupBy("entry", "level").agg(F.sum("n").alias("n")), "ascents")


def _exact(shared, single: bool, k: int):
    """A task's k + 1 best entries for each sampled query."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in source:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                raw, entries, labels = part.column("vec").to_pylist(), part.column("entry").to_pylist(), part.column("labels").to_pylist()
                for size in {len(v) for v in raw}:
                    own = [i for i, v in enumerate(raw) if len(v) == size]
                    points = np.stack([_array(raw[i], single) for i in own])
                    for q, (_, vector) in enumerate(shared.value):
                        if len(vector) == size:
                            score = points @ _array(vector, single)
                            top = np.argpartition(-score, min(k, len(own) - 1))[: k + 1]
                            best[q] = sorted(best.get(q, []) + [(float(score[i]), entries[own[i]], labels[own[i]]) for i in top], reverse=True)[: k + 1]
        rows = [(q, s, e, x) for q, held in best.items() for s, e, x in held]
        if rows:
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "score", "near", "labels"])

    return run


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of labels."""
    differs = a ^ b
    return np.array([BITS - int(x).bit_length() for x in differs.ravel()]).reshape(differs.shape)


def measured_budget(forest: DataFrame, climbed: DataFrame, single: bool, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> int:
    """The least number of entries to meet (of all trees together) with which a sample of queries reaches the recall."""
    some = forest.where("asked is not null").orderBy("entry").limit(sample).select("entry", "vec", "asked").collect()  # md5 order: any entries
    if not some:
        return 0
    shared = forest.sparkSession.sparkContext.broadcast([(r["entry"], r["vec"]) for r in some])
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "near")
    best = forest.select("entry", "vec", "labels").mapInArrow(_exact(shared, single, k), "q int, score double, near binary, labels array<long>")
    best = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).collect()  # at most sample x (k + 1)
    keys = forest.sparkSession.createDataFrame([(r["entry"],) for r in some], "of_entry binary")
    numbers: dict[bytes, list] = {}
    for r in climbed.join(F.broadcast(keys), F.col("entry") == F.col("of_entry")).collect():  # at most sample x BITS
        numbers.setdefault(bytes(r["entry"]), []).append((r["level"], r["n"]))
    depths: dict[int, list[int]] = {}
    for r in best:
        if r["near"] != some[r["q"]]["entry"]:
            depths.setdefault(r["q"], []).append(int(shared_bits(np.array(r["labels"]), np.array(some[r["q"]]["asked"])).max()))

    def reached(wanted: int) -> float:
        shares = []
        for q, d in depths.items():
            level = max((x for x, n in numbers[bytes(some[q]["entry"])] if n >= wanted), default=0)
            shares.append(np.mean(np.array(d) >= level))
        return float(np.mean(shares)) if shares else 1.0

    options = sorted({n for held in numbers.values() for _, n in held})
    lo, hi = 0, len(options)
    while lo < hi:  # recall grows with the number
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if reached(options[mid]) >= recall else (mid + 1, hi)
    return options[lo] if lo < len(options) else np.iinfo(np.int64).max


def _score(single: bool, k: int):
    def run(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best ids of the ranges that queries reach in a cell."""
        cell = cell.iloc[np.argsort(cell["label"].to_numpy(), kind="stable")]
        labels, ids = cell["label"].to_numpy(), cell["ids"].to_list()
        points = np.stack([_array(v, single) for v in cell["vec"]])
        wanted = np.stack([_array(v, single) for v in queries["vec"]])
        lo, hi = _ranges(labels, queries["label"].to_numpy(), queries["level"].to_numpy().astype(np.int64))
        by: dict[tuple[int, int], list[int]] = {}
        for q, span in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            by.setdefault(span, []).append(q)
        of, near, scores = [], [], []
        for (a, b), group in by.items():
            step = max(1, SCORES // max(1, b - a))
            for g in range(0, len(group) if b > a else 0, step):
                own = group[g : g + step]
                product = wanted[own] @ points[a:b].T
                last = min(k, b - a - 1)
                top = np.argpartition(-product, last, axis=1)[:, : last + 1] + a
                for q, places in zip(own, top, strict=True):
                    exact = (points[places] * wanted[q]).sum(axis=1)
                    found = sorted((-s, i) for s, p in zip(exact.tolist(), places.tolist(), strict=True) for i in ids[p])[: k + 1]
                    of += [q] * len(found)
                    scores += [-s for s, _ in found]
                    near += [i for _, i in found]
        return pd.DataFrame({"entry": queries["entry"].to_numpy()[of], "vec_id": np.array(near, np.int64), "score": np.array(scores, np.float64)})

    return run


def _matches(forest: DataFrame, bits: int, cells: DataFrame, levels: DataFrame, single: bool, k: int) -> DataFrame:
    """entry, vec_id, score: of each query's ranges the k + 1 best of each group of a cell's part and a block of queries."""
    asked = forest.where("asked is not null").join(levels.withColumnRenamed("entry", "of_entry"), F.col("entry") == F.col("of_entry"))
    asked = asked.select("entry", "dim", "vec", "level", F.posexplode("asked").alias("nth", "label")).where("level > 0 or nth = 0")  # level 0 is all of a tree: one will do
    asked = asked.withColumn("above", F.expr(f"cast(greatest({bits} - level, 0) as int)"))  # bits of a cell's number that are beyond the prefix
    first = F.expr(f"shiftleft(shiftright(label, {BITS - bits} + above), above)")
    cell = F.explode(F.sequence(first, first + F.expr("shiftleft(1L, above) - 1"))).alias("cell")
    visits = asked.select(F.struct("dim", "nth").alias("tree"), cell, "label", "level", "entry", "vec")
    data = _in_trees(forest.select("entry", "dim", "labels", "vec", "ids"), "labels", bits, "vec", "ids")
    return _met(data, visits, cells).applyInPandas(_score(single, k), "entry binary, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, queried: Column, k: int = K, key: str = "vec_id", field: str = "embedding", trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queried` holds its k nearest other rows, as far as the forest finds them."""
    single = dict(vectors.dtypes)[field] == "array<float>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(field).cast("array<float>" if single else "array<double>").alias("vec"), F.coalesce(queried, F.lit(False)).alias("queried"))
    forest = entries_of(rows, single, k, trees)
    bits = min(40, max(0, math.ceil(math.log2(max(1, forest.count()) / CELL))))
    cells = _in_trees(forest.select("entry", "dim", "labels"), "labels", bits).groupBy("tree", "cell").agg(F.count("*").alias("n"))
    cells = stash(cells.withColumn("parts", F.ceil(F.col("n") / (2 * CELL)).cast("int")), "cells")
    climbed = ascents(forest, bits, cells)
    wanted = max(trees * (k + 1), measured_budget(forest, climbed, single, k, recall=recall))  # some tree then holds k others
    levels = climbed.groupBy("entry").agg(F.coalesce(F.max(F.when(F.col("n") >= F.lit(int(wanted)), F.col("level"))), F.lit(0)).alias("level"))
    found = _matches(forest, bits, cells, stash(levels, "levels"), single, k)
    found = found.groupBy("entry", "vec_id").agg(F.max("score").alias("score"))  # several trees may find it
    order = Window.partitionBy("entry").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    best = best.groupBy(F.col("entry").alias("of_entry")).agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    best = stash(best, "nearest")
    asked = stash(rows.where("queried").mapInArrow(_asked(single), "query_id long, entry binary"), "queries")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    shown = asked.distinct().join(best, F.col("entry") == F.col("of_entry")).select("query_id", F.posexplode(others).alias("at", "x"))
    return shown.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def recall_of(found: list[tuple], vectors: list[tuple[int, np.ndarray]], every: int = 20, k: int = K) -> float:
    """The share of each query's true k best scores that the rows found reach; for tests and reports."""
    ids, points = np.array([i for i, _ in vectors]), np.stack([v for _, v in vectors]).astype(np.float64)
    got: dict[int, list[float]] = {}
    for q, _, _, score in found:
        got.setdefault(q, []).append(score)
    shares = []
    for at in np.flatnonzero(ids % every == 0):
        score = np.delete(points @ points[at], at)
        least = np.sort(score)[-min(k, len(score)) :][0]
        shares.append(sum(s >= least - 1e-12 for s in got.get(int(ids[at]), [])) / min(k, len(score)))
    return float(np.mean(shares))
