"""Benchmark decontamination by the q-gram lemma.

A benchmark text of m characters that stands in a document with at most e edits shares at least m + 1 - q(e + 1) of its
character q-grams with that place, and all of them on diagonals (place in the document less place in the benchmark text)
that differ by at most 2e. So places of the document that share a q-gram are counted in overlapping bands of diagonals, each twice as
wide as needed; bands whose count meets the bound are verified by a banded alignment, and places within the edit budget are reported.
Places of one q-gram in a benchmark text that are at most a band apart count as one run, which reaches a stretch of bands, and counts
are kept as the differences between neighbouring bands, a slice of SLICE runs at a time: memory doesn't grow with how often a
q-gram of a text (dashes, blanks, one letter) repeats in either.

The budget is BUDGET of a text's length, and less for texts so short that the bound would be under one; texts shorter
than q must stand there unchanged. Letters A to Z count as lower case, white space as blanks; offsets are code points.

The benchmark is read in blocks of at most `block_chars` characters. Each block is broadcast, so a broadcast never grows
with the benchmark; the documents are passed over once for every PASS blocks (16 million characters), and never shuffled.

Defined cases: null and empty texts (documents and benchmark) match nothing; equal benchmark texts are each reported;
a null doc_id or item_id is reported as null; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import released, runs, slices, texts_of, whole_text

Q = 10
BUDGET = 0.08
BLOCK_CHARS, PASS = 4_000_000, 4
SLICE = 500_000
CHUNK = 1 << 17
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"
FACTOR = 0x9E3779B1
#: Bits of a code that say where to look whether the benchmark has it.
SEEN = 20
PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BOUNDARY = np.uint32(0xFFFFFFFF)


def normal(text: bytes) -> np.ndarray:
    """Code points; the bytes of A to Z and of white space stand for nothing else in UTF-8."""
    return np.frombuffer(text.translate(PLAIN).decode().encode("utf-32-le"), np.uint32)


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Codes of all q-grams, joined from those of 1, 2, 4, ... characters. Equal codes of different q-grams only add candidates."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    part, width, total, done = points, 1, np.zeros(n, np.uint32), 0
    while True:
        shift = np.uint32(pow(FACTOR, width, 1 << 32))
        if q & width:
            total = total * shift + part[done : done + n]
            done += width
        if 2 * width > q:
            break
        part = part[:-width] * shift + part[width:]
        width *= 2
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    return total


def edit_budget(m: int, q: int = Q, share: float = BUDGET) -> int:
    return max(0, min(int(share * m), (m - q) // q))


class Index:
    """q-grams of a block of benchmark texts: sorted codes with the items and places that have them."""

    def __init__(self, items: list[tuple[int | None, bytes]], q: int = Q, share: float = BUDGET):
        self.q, self.ids = q, [i for i, _ in items]
        self.points = [normal(t) for _, t in items]
        length = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.array([edit_budget(m, q, share) for m in length], np.int64)
        self.width = 2 * self.budget + 1
        self.bound = np.maximum(1, length + 1 - q * (self.budget + 1))
        codes = [grams(p, q) for p in self.points]
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        order = np.argsort(codes, kind="stable")
        codes, item, place = codes[order], item[order], place[order]
        opens = np.ones(len(order), bool)  # places of one text ascend within a code
        opens[1:] = (codes[1:] != codes[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > self.width[item[1:]])
        start = np.flatnonzero(opens)
        stop = np.append(start[1:], len(order)) - 1 if len(start) else start
        self.item, self.run_first, self.run_last = (x.astype(np.int32) for x in (item[start], place[start], place[stop]))
        self.codes, first = np.unique(codes[start], return_index=True)
        self.first = np.append(first, len(start))
        self.seen = np.zeros(1 << SEEN, bool)
        self.seen[self.codes >> np.uint32(32 - SEEN)] = True
        self.short = [k for k, p in enumerate(self.points) if 0 < len(p) < q]
        self.gap = int(self.budget.max(initial=0)) + 1
        self.longest = int(length.max(initial=0))

    def candidates(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands whose shared q-grams meet the bound, those that touch as one."""
        codes = grams(points, self.q)
        at = np.flatnonzero(self.seen[codes >> np.uint32(32 - SEEN)])
        if not len(at) or not len(self.codes):
            return []
        where = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        good = self.codes[where] == codes[at]
        at, where = at[good], where[good]
        count = self.first[where + 1] - self.first[where]
        upto = np.cumsum(count)
        shift = self.longest + 2
        span = len(points) + 2 * shift + 4  # keys of an item; its bands start at -shift
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - count[begin] + SLICE, "right")))
            n = count[begin:end]
            reach = np.repeat(self.first[where[begin:end]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place, item = np.repeat(at[begin:end], n), self.item[reach].astype(np.int64)
            low = np.floor_divide(place - self.run_last[reach], self.width[item]) - 1
            high = np.floor_divide(place - self.run_first[reach], self.width[item])
            base = item * span + shift
            held.append(_summed(np.concatenate([base + low, base + high + 1]), np.repeat(np.array([1, -1]), len(base))))
            if sum(len(k) for k, _ in held[1:]) > 4 * SLICE:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            begin = end
        keys, change = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        count = np.cumsum(change)
        met = np.flatnonzero(count >= self.bound[np.minimum(keys // span, len(self.bound) - 1)])
        out: list[tuple[int, int, int]] = []
        for k in met:  # the last change of an item brings its count to 0, so k + 1 is there and of the same item
            item, first = divmod(int(keys[k]), span)
            low, high = ((first - shift + n) * int(self.width[item]) for n in (0, int(keys[k + 1] - keys[k]) + 1))
            if out and out[-1][0] == item and low <= out[-1][2] + 1:
                low = out.pop()[1]
            out.append((item, low, high - 1))
        return out

    def places(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits), overlapping places of one item told once, with the fewest edits."""
        found: dict[int, list] = {}
        for i, low, high in self.candidates(points):
            e = int(self.budget[i])
            if hits := align(self.points[i], points, low - e, high + e, e):
                found.setdefault(i, []).extend(hits)
        for i in self.short:
            found[i] = [(s, s + len(self.points[i]), 0) for s in _exact(self.points[i], points)]
        return [(i, *hit) for i, hits in found.items() for hit in told_once(hits)]


def told_once(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits): of those that overlap the one with the fewest edits."""
    out: list[tuple[int, int, int]] = []
    for hit in sorted(hits):
        if out and hit[0] < out[-1][1]:
            out[-1] = min(out[-1], hit, key=lambda h: (h[2], h[0]))
        else:
            out.append(hit)
    return out


def _summed(keys: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its changes; those of sum 0 go."""
    keys, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, change, len(keys)).astype(np.int64)
    return keys[total != 0], total[total != 0]


def _exact(pattern: np.ndarray, points: np.ndarray) -> np.ndarray:
    n = len(points) - len(pattern) + 1
    good = np.ones(max(0, n), bool)
    for k, c in enumerate(pattern):
        good &= points[k : n + k] == c
    return np.flatnonzero(good)


def _find(pattern: np.ndarray, points: np.ndarray) -> int:
    """The first place where the pattern stands unchanged, or -1."""
    whole, part, at = points.tobytes(), pattern.tobytes(), -1
    while (at := whole.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def _band(pattern: np.ndarray, points: np.ndarray, low: int, high: int, free_start: bool, budget: int) -> np.ndarray:
    """Edits after the whole pattern, for each diagonal from low to high; big where none can be. The fewest edits never
    fall from row to row, so it ends once they are over the budget."""
    big = 1 << 20
    k = np.arange(low, high + 1)
    n = len(points)
    row = np.where((k >= 0) & (k <= n), 0 if free_start else np.abs(k), big)
    padded = np.concatenate([points, np.full(1, BOUNDARY)])
    for i, c in enumerate(pattern):
        j = i + k  # the character that a step along the diagonal uses
        inside = (j >= 0) & (j < n)
        best = np.where(inside, row + (padded[np.where(inside, j, n)] != c), big)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(j + 1 < 0) | (j + 1 > n)] = big
        row = np.minimum.accumulate(best - k) + k
        if i % 8 == 7 and row.min() > budget:
            break
        row[(j + 1 < 0) | (j + 1 > n)] = big
    return row


def align(pattern: np.ndarray, points: np.ndarray, low: int, high: int, budget: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the places of the pattern on diagonals low to high that are within the budget: of those that
    overlap the one with the fewest edits."""
    m = len(pattern)
    base = max(0, low)
    window = points[base : max(base, high + m + 1)]
    if high - low + budget < m:  # too narrow for two places that don't overlap, and nothing is better than an unchanged copy
        at = _find(pattern, window)
        if at >= 0:
            return [(base + at, base + at + m, 0)]
    row = _band(pattern, window, low - base, high - base, True, budget)
    good = np.flatnonzero(row <= budget)
    taken, out = np.zeros(len(row), bool), []
    for at in good[np.argsort(row[good], kind="stable")]:
        if not taken[at]:
            end = m + low - base + int(at)
            back = _band(pattern[::-1], window[:end][::-1], -budget, budget, False, budget)
            start = end - (m + int(np.flatnonzero(back == back.min())[0]) - budget)
            out.append((base + start, base + end, int(row[at])))
            taken[max(0, start - m - low + base + 1) : end - budget - low + base] = True  # ends of places that overlap it
    return out


def _match(indexes: list):
    names = ["doc_id", "item_id", "start", "end", "edits"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def search(ix: Index, pieces: list[np.ndarray]) -> Iterator[tuple]:
        """(piece, item_id, start, end, edits) over all pieces, joined with gaps that nothing matches."""
        gap = np.full(ix.gap, BOUNDARY)
        begins = np.cumsum([0, *(len(p) + len(gap) for p in pieces)])
        points = np.concatenate([x for p in pieces for x in (p, gap)])
        seam = ix.longest + 4 * ix.gap + 4
        found: dict[int, list] = {}
        for at in range(0, len(points), CHUNK):  # long texts in chunks that overlap by more than any place
            first = max(0, at - seam)
            for item, start, end, edits in ix.places(points[first : at + CHUNK]):
                found.setdefault(item, []).append((start + first, end + first, edits))
        for item, hits in found.items():
            for start, end, edits in told_once(hits):
                piece = int(np.searchsorted(begins, start, "right")) - 1
                yield piece, ix.ids[item], start - int(begins[piece]), end - int(begins[piece]), edits

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            texts, ids, out = texts_of(batch), batch.column("doc_id").to_pylist(), []
            for lo, hi in runs(texts, CHUNK):
                pieces = [normal(t) for t in texts[lo:hi]]
                for ix in indexes:
                    out += [(ids[lo + k], *found) for k, *found in search(ix.value, pieces)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''").toLocalIterator():
        text = row["text"].encode()
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits of every place where a benchmark text stands in a document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    indexes = [spark.sparkContext.broadcast(Index(block, q, share)) for block in _blocks(benchmark, block_chars)]
    parts = [rows.mapInArrow(released(_match(indexes[k : k + PASS])), SCHEMA) for k in range(0, len(indexes), PASS)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], q: int = Q, share: float = BUDGET) -> set[tuple[int, int]]:
    """(doc_id, item_id) by full alignment of each item with each document, for tests."""
    out = set()
    for i, t in items:
        p = normal((t or "").encode())
        for d, text in rows:
            x = normal((text or "").encode())
            if len(p) and len(x):
                row = list(range(len(p) + 1))
                best = row[-1]
                for c in x:
                    last, row[0] = row[0], 0
                    for k in range(1, len(p) + 1):
                        last, row[k] = row[k], min(last + (p[k - 1] != c), row[k] + 1, row[k - 1] + 1)
                    best = min(best, row[-1])
                if best <= edit_budget(len(p), q, share):
                    out.add((d, i))
    return out
