"""Sequence packing by non-negative least squares on the length histogram.

A document is its token ids and one end id (0). It is cut into pieces of WINDOW ids and a shorter rest. All combinations
of one, two or three lengths that fill a window exactly are enumerated; repeat counts x >= 0 that best explain the
histogram h of the lengths (|Ax - h|^2) are found by accelerated projected gradient steps, until the residual no longer
falls, rounded, and limited to what is there (lengths that no combination holds are left to the last step); the residual histogram is packed greedily, largest length first, each window filled with the largest
lengths that still fit. Full pieces are windows of their own.

The histogram has at most WINDOW rows, so the plan costs the same for any corpus and only that goes through the driver.
Pieces get their place among those of their length in cells of about CELL rows (a length may hold a third of all pieces; the
number of a written row picks its cell, so equal rows spread), and the plan says for each place the sequence and the offset.

Tokens: byte-level BPE with the ranks of a vocabulary file (a parameter). Text is cut where the vocabulary's pattern always cuts,
before a blank that a word follows, and the ids of a chunk are kept; texts with the separators 28 to 31, which Python and the pattern class
differently, go to the encoder whole. The strings of the added tokens that the vocabulary's JSON file lists become their own ids, as in a
plain call of that file's tokenizer.

Defined cases: null text is empty: its only id is the end id; repeated rows and null doc_ids are packed like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import released, stash, whole_text

WINDOW, END, CELL = 1024, 0, 1024
#: The solver ends when PATIENCE steps took less than GAIN off the residual, or when that is under LEFT of the histogram's size.
PATIENCE, GAIN, LEFT = 50, 0.01, 1e-4
CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f]")
KNOWN = 250_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Strings that a tokenizer's JSON file gives an id of their own; a plain call cuts them out before anything else."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder(dict):
    """Chunk to the bytes of its ids (unsigned, 32 bits, little-endian)."""

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] | None = None):
        import tiktoken

        self.added = {t: k.to_bytes(4, "little") for t, k in (added or {}).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("quern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        value = array("I", self.encode(chunk)).tobytes()
        if len(self) < KNOWN and len(chunk) < 40:
            self[chunk] = value
        return value

    def ids(self, text: str) -> bytes:
        if self.cut and len(parts := self.cut.split(text)) > 1:
            return b"".join(self.added.get(p) or self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if ODD.search(text):
            return array("I", self.encode(text)).tobytes()
        return b"".join(map(self.__getitem__, CHUNKS.findall(text)))


def _cut(path: str, pattern: str | None, added: dict[str, int], window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern, added)
        for batch in source:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text) + END.to_bytes(4, "little")
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    for column, v in zip(out, (doc, a, len(part) // 4, zlib.crc32(part), n, part if with_ids else None), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def combinations(window: int) -> np.ndarray:
    """All lengths a >= b >= c >= 0 with sum `window` and a < window; 0: no piece."""
    b, c = np.meshgrid(np.arange(1, window), np.arange(window), indexing="ij")
    b, c = b.ravel(), c.ravel()
    a = window - b - c
    good = (a >= b) & (b >= c)
    return np.stack([a[good], b[good], c[good]], axis=1)


def least_squares(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """x >= 0 with small |Ax - h|, where column k of A counts the lengths in combos[k]."""
    n = len(histogram)
    keep = histogram[combos[:, 0]] * histogram[combos[:, 1]] * np.where(combos[:, 2] > 0, histogram[combos[:, 2]], 1) > 0
    x = np.zeros(len(combos))
    used = combos[keep]
    if not len(used):
        return x
    flat, real = used.ravel(), (used > 0).ravel()

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(v, 3) * real, n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[flat] * real).reshape(-1, 3).sum(axis=1)

    v = np.ones(len(used))  # the largest eigenvalue of A'A bounds the step
    for _ in range(20):
        w = back(times(v))
        size = np.linalg.norm(w)
        v = w / size
    step = 1 / (1.05 * size)
    now = ahead = best = np.zeros(len(used))
    momentum, least, waited, mark = 1.0, math.inf, 0, math.inf
    enough = LEFT * np.linalg.norm(histogram)
    while least > enough and waited < PATIENCE:
        rest = times(ahead) - histogram
        if (size := float(np.linalg.norm(rest))) < least:
            least, best = size, ahead
        waited += 1
        if least < (1 - GAIN) * mark:
            mark, waited = least, 0
        new = np.maximum(0, ahead - step * back(rest))
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = np.maximum(0, new + (momentum - 1) / following * (new - now))
        now, momentum = new, following
    x[keep] = best
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int, str]]:
    """(lengths, repeats, what made it: full, solved or greedy): windows that use every piece exactly once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int, str]] = []
    if left[window]:
        made.append(((window,), int(left[window]), "full"))
        left[window] = 0
    if left.any() and window >= 2:
        combos = combinations(window)
        x = np.round(least_squares(left.astype(float), combos)).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] <= 0:
                break
            lengths = tuple(int(v) for v in combos[k] if v)
            n = min(int(x[k]), *(int(left[v]) // lengths.count(v) for v in set(lengths)))
            if n > 0:
                made.append((lengths, n, "solved"))
                for v in lengths:
                    left[v] -= n
    present = [int(v) for v in np.flatnonzero(left)[::-1]]
    while present:
        room, lengths = window, []
        taken: dict[int, int] = {}
        for v in present:
            n = min(room // v, int(left[v]))
            if n:
                taken[v] = n
                lengths += [v] * n
                room -= n * v
            if not room:
                break
        n = min(int(left[v]) // k for v, k in taken.items())
        made.append((tuple(lengths), n, "greedy"))
        for v, k in taken.items():
            left[v] -= n * k
        present = [v for v in present if left[v]]
    return made


def report(made: list[tuple[tuple[int, ...], int, str]], window: int = WINDOW) -> dict[str, float]:
    """Of a plan: sequences, the share of them that each step made, and the share of padding."""
    total = sum(n for _, n, _ in made)
    shares = {by: sum(n for _, n, b in made if b == by) / max(1, total) for by in ("full", "solved", "greedy")}
    return {"sequences": total, **shares, "padding": 1 - sum(sum(ls) * n for ls, n, _ in made) / max(1, window * total)}


class Places:
    """For the pieces of a length, in ranges of their rank: first sequence and offset."""

    def __init__(self, made: list[tuple[tuple[int, ...], int, str]], window: int = WINDOW):
        rank, rows, sequence = [0] * (window + 1), [], 0
        for lengths, n, _ in made:
            offset = 0
            for v in lengths:
                rows.append((v, rank[v], sequence, offset))
                rank[v] += n
                offset += v
            sequence += n
        rows.sort()
        self.length, self.rank, self.sequence, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
        self.begin = np.searchsorted(self.length, np.arange(window + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for v in np.unique(length):
            mine = length == v
            lo, hi = self.begin[v], self.begin[v + 1]
            at[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def _place(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def length_counts(pieces: DataFrame) -> dict[int, int]:
    """Pieces of each length, at most as many rows as a window has places."""
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, window: int = WINDOW, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece; with_ids: and ids (binary). path and added: a
    vocabulary and its strings with an id of their own (with another vocabulary than the default one none, unless they are given)."""
    if added is None:
        added = {} if path else added_tokens()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cut = rows.mapInArrow(released(_cut(path or vocabulary_file(), pattern, added, window, with_ids)), PIECE)
    pieces = stash(cut.withColumn("number", F.monotonically_increasing_id()), "pieces")  # written, so numbers stay
    counts = length_counts(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, window), window))
    cells = F.from_json(F.lit(json.dumps([math.ceil(counts.get(k, 0) / CELL) for k in range(window + 1)])), "array<long>")
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("number"), F.get(cells, F.col("length").cast("int"))))
    before = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = before.select(
        F.col("length").alias("of_length"), F.col("cell").alias("of_cell"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("length", "cell").orderBy("number")
    ranked = pieces.withColumn("nth", F.row_number().over(within)).join(before, (F.col("length") == F.col("of_length")) & (F.col("cell") == F.col("of_cell")))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("nth") - 1).cast("long").alias("rank"))
    placed = ranked.mapInArrow(released(_place(shared)), PIECE + ", sequence_id long, offset long")
    return placed if with_ids else placed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, unpadded) and pieces (doc_id, start, length, offset) of each sequence; packed with_ids."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # at most a window of ids
    merged = packed.groupBy("sequence_id").agg(own.alias("p"))
    return merged.select("sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.ids)).alias("ids"), F.transform("p", lambda x: F.struct(x.doc_id, x.start, x.length, x.offset)).alias("pieces"))
