"""Substring deduplication: Rabin-Karp hashes of every window of words, counted over the corpus.

Every window of `width` consecutive words gets a 64-bit Rabin-Karp code. A window is repeated when its code also starts
in a document of smaller doc_id; the words that repeated windows cover merge into maximal removal intervals.

How it runs: windows travel in runs. The bucket of a window is the least hash of the GRAM-word sequences in it, so neighbouring windows
mostly share it, and a run (text, first place, codes) costs little more than its codes. Spark brings the runs of a bucket together,
unfolds them into one row for each window, and takes the least doc_id over the rows of a code; rows of a larger doc_id are repeated
windows. A sequence that very many windows have as their least one would fill a single bucket: such buckets are found in a sample of
documents beforehand (`crowded`), and their windows are dealt by their own code instead. The sample decides only which task compares a
window, as that of a range partitioning does, never the result.

A passage that a third of all documents hold would bring as many rows to one code, so each task first compares the windows it holds
(COMBINE at a time, the map-side part of the minimum): of each code only the smallest doc_id goes on, in one row, with all places that the
text has the window at; the others are repeated whatever else there is: they merge into intervals at once and are spread over all
tasks. Repeated windows then meet by document, where a window function merges them into intervals, and these join the documents, whose
texts travel compressed. Two different windows share a code with a chance of 2**-64, and so does an interval, which has a random one,
with a window.

Defined cases: null text is empty; a text of fewer words than `width` has no window and stays; repeats within one
document stay; rows of equal doc_id count as one document for the comparison, and each has its own words removed; a row whose
doc_id is null is neither compared nor changed. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import released, runs, stash, texts_of, whole_text
from .wordgrid import WordGrid, scramble, window_codes, word_grid

WIDTH = 13
#: Windows that a task compares before they are shuffled, and runs of a batch that it hands on.
COMBINE, BATCH = 2_000_000, 20_000
#: Words of the sequences whose least hash is the bucket.
GRAM = 3
#: A bucket is crowded if it has over 1/(SHARE * shuffle partitions) of the sampled windows: there are fewer than SHARE * partitions of them.
SHARE = 8
#: Documents sampled for that, for each shuffle partition, and at least.
SAMPLE, SAMPLE_LEAST = 20, 2000
WINDOWS = "bucket int, doc long, body long, place int, end int, codes array<long>, more array<int>"


def _buckets(grid: WordGrid, width: int) -> np.ndarray:
    """For each window of `width` words, by its first word: the least hash of the word sequences in it, as 31 bits."""
    gram = min(GRAM, width)
    least, _ = window_codes(WordGrid(np.zeros(len(grid.code), np.int64), grid.code), gram)
    held, wanted = 1, width - gram + 1
    while held < wanted:
        step = min(held, wanted - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    return (least >> np.uint64(33)).astype(np.int32)


def _known_repeats(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows a smaller doc_id among these also has."""
    order = np.lexsort((docs, codes))
    codes, docs = codes[order], docs[order]
    head = np.ones(len(codes), bool)
    head[1:] = codes[1:] != codes[:-1]
    known = np.empty(len(codes), bool)
    known[order] = docs > docs[head][np.cumsum(head) - 1]
    return known


def _groups(codes: np.ndarray, places: np.ndarray, bodies: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(one index for each code and text, in the order given; by position there, the further places of those that have any)."""
    order = np.lexsort((np.arange(len(codes)), bodies, codes))
    head = np.ones(len(codes), bool)
    head[1:] = (codes[order][1:] != codes[order][:-1]) | (bodies[order][1:] != bodies[order][:-1])
    first = np.flatnonzero(head)
    size = np.diff(first, append=len(codes))
    back = np.argsort(order[first])
    first, size = first[back], size[back]
    return order[first], {i: places[order[first[i] + 1 : first[i] + size[i]]] for i in np.flatnonzero(size > 1).tolist()}


def _intervals(places: np.ndarray, docs: np.ndarray, bodies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in text order: the index of the first one of each interval, and where the interval ends."""
    opens = np.ones(len(places), bool)
    opens[1:] = (docs[1:] != docs[:-1]) | (bodies[1:] != bodies[:-1]) | (places[1:] < places[:-1]) | (places[1:] - places[:-1] > width)
    first = np.flatnonzero(opens)
    return first, places[np.append(first[1:], len(places)) - 1] + width if len(first) else places


def _windows(width: int, crowd: np.ndarray):
    names = [f.split()[0] for f in WINDOWS.split(", ")]

    def batches(columns: list[np.ndarray], ends: np.ndarray | None, codes: np.ndarray, heads: np.ndarray, more: dict) -> Iterator[pa.RecordBatch]:
        """Rows of the windows or intervals at `heads`, each with the codes up to the next one."""
        bounds = np.append(heads, len(codes)).astype(np.int32)
        for k in range(0, len(heads), BATCH):
            at, cut = heads[k : k + BATCH], bounds[k : k + BATCH + 1]
            lists = pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(codes[cut[0] : cut[-1]].view(np.int64)))
            further = pa.array([more.get(i) for i in at.tolist()], pa.list_(pa.int32())) if more else pa.nulls(len(at), pa.list_(pa.int32()))
            until = pa.nulls(len(at), pa.int32()) if ends is None else pa.array(ends[at])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), until, lists, further], names)

    def combined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        codes, buckets, places, docs, bodies = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        known = _known_repeats(codes, docs)
        own, repeated = np.flatnonzero(~known), np.flatnonzero(known)
        one, more = _groups(codes[own], places[own], bodies[own])
        own = own[one]
        alone = np.zeros(len(own), bool)
        alone[list(more)] = True
        head = np.ones(len(own), bool)  # where a run begins: at another bucket, text or place, and at windows that have further places
        same = [x[own][1:] == x[own][:-1] for x in (buckets, docs, bodies)] + [places[own][1:] == places[own][:-1] + 1]
        head[1:] = ~np.logical_and.reduce(same) | alone[1:] | alone[:-1]
        begun = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))
        head |= (np.arange(len(own)) - begun) % width == 0  # so that whatever windows of a run are repeated cover one interval
        yield from batches([x[own] for x in (buckets, docs, bodies, places)], None, codes[own], np.flatnonzero(head), more)
        first, ends = _intervals(places[repeated], docs[repeated], bodies[repeated], width)
        at = repeated[first]
        spread = scramble(bodies[at].view(np.uint64) ^ scramble(docs[at].view(np.uint64) + places[at].astype(np.uint64)))  # in place of a code: anywhere
        own_bucket = (spread >> np.uint64(33)).astype(np.int32)
        yield from batches([own_bucket, docs[at], bodies[at], places[at]], ends.astype(np.int32), spread, np.arange(len(at)), {})

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in source:
            texts = texts_of(batch)
            docs, bodies = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("doc_id", "body"))
            for lo, hi in runs(texts):
                grid = word_grid(texts[lo:hi])
                codes, at = window_codes(grid, width)
                if not len(codes):
                    continue
                owner, buckets = grid.doc[at], _buckets(grid, width)[at]
                buckets = np.where(np.isin(buckets, crowd), (codes >> np.uint64(33)).astype(np.int32), buckets)
                held.append((codes, buckets, (at - np.searchsorted(grid.doc, owner)).astype(np.int32), docs[lo + owner], bodies[lo + owner]))
                count += len(codes)
                if count >= COMBINE:
                    yield from combined(held)
                    held, count = [], 0
        if count:
            yield from combined(held)

    return released(run)


def _bucket_counts(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = texts_of(batch)
            for lo, hi in runs(texts):
                grid = word_grid(texts[lo:hi])
                codes, at = window_codes(grid, width)
                if len(codes):
                    _, one = np.unique(codes, return_index=True)  # equal windows of a task are compared there
                    bucket, n = np.unique(_buckets(grid, width)[at[one]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    return run


def crowded(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The buckets that hold an outsized share of the windows of a sample of documents, sorted; fewer than SHARE * shuffle partitions."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, max(SAMPLE_LEAST, SAMPLE * parts) / max(1, docs.count()))
    counts = docs.sample(share, seed=1).select(whole_text().alias("text")).mapInArrow(_bucket_counts(width), "bucket int, n long")
    counts = stash(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("n") * SHARE * parts > total) & (F.col("n") > 16)).select("bucket").collect()
    return np.sort(np.array([r.bucket for r in found], np.int32))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and body, which tells apart the rows of one doc_id: a hash of the text; 0 where no doc_id occurs twice (this is looked up)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    unique = ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    body = F.lit(0).cast("long") if unique else F.xxhash64(whole_text())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), body.alias("body"))


def _unfolded(windows: DataFrame) -> DataFrame:
    """One row for each window of the runs (its place there is nth), dealt by bucket."""
    kept = [F.col(c) for c in ("bucket", "doc", "body", "place", "end", "more")]
    return windows.repartition("bucket").select(*kept, F.posexplode("codes").alias("nth", "code"))


def removal_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """of_doc, of_body, spans (pairs of first word and end, in order): the word ranges that windows cover which a document
    of smaller doc_id also has; one row for each text that has any."""
    return _removals(_rows(docs), width)


def _removals(rows: DataFrame, width: int) -> DataFrame:
    rows = rows.where("doc_id is not null")
    windows = _unfolded(rows.mapInArrow(_windows(width, crowded(rows, width)), WINDOWS))
    least = F.min("doc").over(Window.partitionBy("code", "bucket"))  # dealt by bucket already
    repeated = windows.withColumn("least", least).where("end is not null or doc > least")
    # A run is at most `width` windows long: those that are repeated overlap. It is one row again before it travels.
    found = repeated.groupBy("bucket", "doc", "body", "place", "end", "more").agg(F.min("nth").alias("lo"), F.max("nth").alias("hi"))
    places = F.explode(F.concat(F.array(F.col("place") + F.col("lo")), F.coalesce("more", F.array().cast("array<int>")))).alias("place")
    found = found.select("doc", "body", places, "end", (F.col("hi") - F.col("lo") + width).alias("length"))
    found = found.select("doc", "body", "place", F.coalesce("end", F.col("place") + F.col("length")).alias("end"))
    order = Window.partitionBy("doc", "body").orderBy("place")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("opens", F.coalesce(F.col("place") > before, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("doc", "body", "part").agg(F.min("place").alias("first"), F.max("end").alias("end"))
    spans = F.sort_array(F.collect_list(F.array("first", "end")))  # of one text, fewer than its words
    return merged.groupBy(F.col("doc").alias("of_doc"), F.col("body").alias("of_body")).agg(spans.alias("spans"))


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, body and the text compressed, as it travels."""
    pack = zstandard.ZstdCompressor().compress
    for batch in source:
        for lo, hi in runs(texts := texts_of(batch)):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), pa.array(map(pack, texts[lo:hi]), pa.binary())], ["doc_id", "body", "packed"])


def _strip():
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("intervals", pa.list_(pa.list_(pa.int32())))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in source:
            out = {k: [] for k in schema.names}
            for doc, packed, spans in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "packed", "spans")), strict=True):
                words = unpack(packed).split()  # bytes split at just the six blanks
                kept, last, removed = [], 0, 0
                for a, b in spans or []:
                    kept += words[last:a]
                    last, removed = b, removed + b - a
                kept += words[last:]
                for k, v in zip(schema.names, (doc, len(words), removed, b" ".join(kept), spans or []), strict=True):
                    out[k].append(v)
                if sum(map(len, out["kept"][-1:])) > 1 << 20 or len(out["kept"]) >= 1000:
                    yield _made(out, schema)
                    out = {k: [] for k in schema.names}
            if out["kept"]:
                yield _made(out, schema)

    return run


def _made(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(out[k], pa.binary()).cast(pa.string()) if k == "kept" else pa.array(out[k], schema.field(k).type) for k in schema.names]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank), intervals (word ranges taken out)."""
    rows = _rows(docs)
    found = _removals(rows, width)
    rows = rows.mapInArrow(_packed, "doc_id long, body long, packed binary")
    joined = rows.join(found, (F.col("doc_id") == F.col("of_doc")) & (F.col("body") == F.col("of_body")), "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_strip(), "doc_id long, n_words long, n_removed long, kept string, intervals array<array<int>>")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(width: int = WIDTH) -> str:
    """The digest for DuckDB."""
    return rf"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})),
    m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
    r AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN m USING (g), range({width}) t(k) WHERE doc_id > least),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    """The same by plain loops, for tests."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least: dict = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
