"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact size.

1. Rows are written once, as size, checksum and a number of their own, and fall into blocks by a seeded hash of that number (so equal
   rows spread like others); the rows of each block are counted. The texts are read once.
2. For each block the number of its rows for each shard is drawn as a uniform random permutation would have it: from a
   multivariate hypergeometric distribution over the places still free in the shards (exact draws, seeded).
3. Rows are permuted within their block by a seeded hash; the drawn counts cut that order into the shards' parts.
4. After the exchange the rows of a shard are permuted once more, by another hash, in cells of about CELL rows; the
   place of a row in its cell and the rows of the cells before it give its slot.

The law that holds is `rows`: shard sizes differ by at most one row. There are eight blocks for every BLOCK rows, at most
MOST_BLOCKS of them, since the driver draws the matrix of shards x blocks numbers one by one. So a block has some BLOCK / 8 rows up to
400 million rows; beyond that it is a MOST_BLOCKS-th of the table (305,000 of 10 billion rows), and sorting it may spill. There is a cell
for every CELL rows. Only block and cell counts go through the driver or a broadcast. The draws use differences of log-gamma values,
by which a probability is off by a factor of about 1e-6 at a billion rows and 1e-3 at 1e11.

Defined cases: null text has 0 bytes; an empty table gives no rows; equal rows have numbers of their own, so there are
no ties; rows of equal text needn't share a shard; other columns are ignored. The same table read in the same
partitions gives the same shards; read in others it gives another shuffle, as uniform and of the same sizes (numbers follow partitions).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import stash, whole_text

SHARDS, BLOCK, CELL, MOST_BLOCKS = 40, 100_000, 50_000, 32_768
OVERHEAD = 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` of good + bad, by inversion from the mode outwards: the steps are of the order of the
    standard deviation."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - top
    up = down = mode
    p_up = p_down = top
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """For each block the rows that go to each shard; columns sum to the capacities."""
    rng, free, matrix = random.Random(seed), list(capacities), []
    for size in sizes:
        left, room, row = size, sum(free), []
        for k, c in enumerate(free):
            n = hypergeometric(rng, c, room - c, left)
            row.append(n)
            room, left = room - c, left - n
            free[k] -= n
        matrix.append(row)
    return matrix


def capacities_of(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table as a constant in the plan."""
    kinds = ", ".join(f"{n} {'array<long>' if isinstance(v, list) else 'long'}" for n, v in zip(names, rows[0], strict=True))
    text = "[" + ",".join("{" + ",".join(f'"{n}":{v}' for n, v in zip(names, r, strict=True)) + "}" for r in rows) + "]"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kinds}>>")).alias("r")).select("r.*")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(whole_text()) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = stash(rows, "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    blocks = min(MOST_BLOCKS, math.ceil(total / BLOCK) * 8)
    cells = max(1, math.ceil(total / shards / CELL))
    code = F.xxhash64("number", F.lit(seed))
    keyed = rows.select("doc_id", "size", "text_crc32", F.pmod(code, F.lit(blocks)).alias("block"), code.alias("first"))
    sizes = sorted((r["block"], r["count"]) for r in keyed.groupBy("block").count().collect())  # at most MOST_BLOCKS rows
    matrix = communication_matrix([n for _, n in sizes], capacities_of(total, shards), seed)
    ends = [[sum(row[: k + 1]) for k in range(shards)] for row in matrix]
    cuts = F.broadcast(_table(spark, [(b, e) for (b, _), e in zip(sizes, ends, strict=True)], ["of_block", "ends"]))
    order = Window.partitionBy("block").orderBy(F.xxhash64("first", F.lit(seed + 1)), "first")
    placed = keyed.withColumn("place", F.row_number().over(order).cast("long"))
    placed = placed.join(cuts, F.col("block") == F.col("of_block"))
    dealt = placed.select(
        "doc_id", "size", "text_crc32",
        F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard"),
        F.xxhash64("first", F.lit(seed + 2)).alias("second"),
    )
    dealt = dealt.withColumn("cell", F.pmod("second", F.lit(cells)).cast("int"))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    before = counts.select(
        F.col("shard").alias("of_shard"), F.col("cell").alias("of_cell"),
        (F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")).alias("before"),
    )
    within = Window.partitionBy("shard", "cell").orderBy("second")
    dealt = dealt.withColumn("nth", F.row_number().over(within).cast("long"))
    dealt = dealt.join(before, (F.col("shard") == F.col("of_shard")) & (F.col("cell") == F.col("of_cell")))
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute_force(rows: list[tuple[int, int, str | None]], shards: int = SHARDS, seed: int = 20) -> list[tuple]:
    """(doc_id, size, text_crc32, shard, slot) by plain loops, for tests; rows: number, doc_id and text of each row."""
    import zlib

    import xxhash

    def code(*parts: tuple[int, int]) -> int:
        h = 42
        for value, width in parts:
            h = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    blocks = min(MOST_BLOCKS, math.ceil(len(rows) / BLOCK) * 8)
    cells = max(1, math.ceil(len(rows) / shards / CELL))
    first = {n: code((n, 8), (seed, 4)) for n, _, _ in rows}
    members: dict[int, list[int]] = {}
    for n, h in first.items():
        members.setdefault(h % blocks, []).append(n)
    matrix = communication_matrix([len(members[b]) for b in sorted(members)], capacities_of(len(rows), shards), seed)
    dealt: dict[int, list[int]] = {k: [] for k in range(shards)}
    for b, counts in zip(sorted(members), matrix, strict=True):
        order = iter(sorted(members[b], key=lambda n: (code((first[n], 8), (seed + 1, 4)), first[n])))
        for k, count in enumerate(counts):
            dealt[k] += [next(order) for _ in range(count)]
    slot = {}
    for k, own in dealt.items():
        second = {n: code((first[n], 8), (seed + 2, 4)) for n in own}
        for at, n in enumerate(sorted(own, key=lambda n: (second[n] % cells, second[n]))):
            slot[n] = (k, at)
    text = {n: (d, (t or "").encode()) for n, d, t in rows}
    return [(d, len(t) + OVERHEAD, zlib.crc32(t), *slot[n]) for n, (d, t) in text.items()]
