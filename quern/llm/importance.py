"""Importance resampling towards a target distribution, by an external sort-count of hashed n-grams.

1. Every text becomes a stream of bucket numbers, one for each run of one to three words, packed as uint16. Streams of neighbouring
   documents are written together (about STREAM features a row) with the documents' offsets.
2. Each stream is sorted and run-length encoded; its runs (bucket, count) meet by bucket, where Spark adds them up: the table of counts has
   one row for each bucket whatever the corpus. The target's texts are counted likewise.
3. A bucket's gain comes from the two counts. A second pass over the written streams gathers the gains and adds them up between the
   offsets (np.add.reduceat): a document's weight. Texts are read and hashed once.
4. Gumbel noise from a hash of the doc_id turns weights into scores; the best FRACTION percent of the documents with enough words are a draw
   without replacement in proportion to exp(weight / 1000). Ranks are counted in range partitions of the scores, no task sees all of them.

Only gains (one number for each of BUCKETS buckets) and the counts of range partitions are collected or broadcast.

Defined cases: null text has no words; a row whose doc_id is null has a weight but neither score nor rank and isn't counted for the draw; rows
that share a doc_id are rows of their own, ties between them go to fewer features, then the smaller weight; an empty target or corpus leaves
counts of zero. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_at, stash, texts_of, whole_text

BUCKETS, LONGEST = 10_000, 3
SCALE, SEED = 1000, 42
LEAST_WORDS, FRACTION = 20, 5
#: Features of a packed stream; a longer document is a stream of its own.
STREAM = 1 << 19
STREAMS = "docs array<long>, words array<long>, offsets array<long>, stream binary"

#: Words are runs of digits, small letters (capitals are lowered first) and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def text_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each run of one to three words) of one text."""
    parts, before, n = [], [], 0
    for piece in cut_at(text.lower(), WORD):  # lower() of bytes changes A-Z only
        words = WORD.findall(piece)
        n += len(words)
        joined = before + words
        own = [crc32(w) for w in joined]
        spaced = [b" " + w for w in joined]
        codes = own[len(before) :]
        for width in range(2, LONGEST + 1):  # crc32(a + b) goes on from crc32(a)
            own = list(map(crc32, spaced[width - 1 :], own))
            codes += own[max(0, len(before) - width + 1) :]
        parts.append((np.array(codes, np.uint32) % np.uint32(buckets)).astype(np.uint16))
        before = joined[-(LONGEST - 1) :]
    return n, np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _pack(buckets: int):
    names = ["docs", "words", "offsets", "stream"]

    def made(held: list[tuple]) -> pa.RecordBatch:
        docs, words, streams = zip(*held, strict=True)
        offsets = np.zeros(len(docs), np.int64)
        np.cumsum([len(s) for s in streams[:-1]], out=offsets[1:])
        columns = [pa.array([list(docs)], pa.list_(pa.int64())), pa.array([list(words)], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([np.concatenate(streams).astype("<u2").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in source:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                    words, stream = text_buckets(text, buckets)
                    held.append((doc, words, stream))
                    size += len(stream) + 8
                    if size >= STREAM:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    return run


def packed_streams(docs: DataFrame, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """docs, words, offsets (one entry for each document) and stream (little-endian uint16) of runs of documents."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_pack(buckets), STREAMS)


def _runs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run-length encoding of each sorted stream."""
    for batch in source:
        for stream in batch.column("stream"):
            bucket, n = np.unique(np.frombuffer(stream.as_buffer(), "<u2"), return_counts=True)  # sorts
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])


def bucket_counts(streams: DataFrame) -> DataFrame:
    """bucket, n: at most BUCKETS rows."""
    return streams.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the floored, scaled log ratio of its smoothed shares of the target and of the corpus."""
    total, wanted = sum(raw.values()), sum(target.values())
    ratio = ((target.get(b, 0) + 1) * float(total + buckets) / ((raw.get(b, 0) + 1) * float(wanted + buckets)) for b in range(buckets))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def _weigh(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in source:
            for k in range(batch.num_rows):
                stream = np.frombuffer(batch.column("stream")[k].as_buffer(), "<u2")
                offsets = batch.column("offsets")[k].values.to_numpy()
                sizes = np.diff(offsets, append=len(stream))
                weights, filled = np.zeros(len(offsets), np.int64), sizes > 0
                if filled.any():
                    weights[filled] = np.add.reduceat(gain[stream], offsets[filled])
                columns = [batch.column("docs")[k].values, batch.column("words")[k].values, pa.array(sizes), pa.array(weights)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return run


def with_scores(weighed: DataFrame) -> DataFrame:
    """score: the weight and Gumbel noise drawn from the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(scored: DataFrame, fraction: int = FRACTION, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored and rank: 1, 2, 3 ... for the best fraction percent (rounded down) of the documents with enough words, else null.

    The order is made of range partitions: their sizes are counted, and a row's rank is its place in its own partition after
    the sizes of those before.
    """
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    spark = scored.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    dealt = stash(scored.where(eligible).repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dict(dealt.groupBy("part").count().collect())  # one row for each range
    drawn = fraction * sum(sizes.values()) // 100
    before, begins = 0, []
    for p in sorted(sizes):
        if before < drawn:
            begins.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(begins, "of_part int, before long")
    own = dealt.join(F.broadcast(starts), F.col("part") == F.col("of_part"))  # the ranges that the draw reaches into
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = own.withColumn("rank", place.cast("long")).select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    beyond = dealt.join(F.broadcast(starts), F.col("part") == F.col("of_part"), "left_anti").select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    rest = scored.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(beyond).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, fraction: int = FRACTION, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; target: a table with text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    streams = stash(packed_streams(docs, buckets), "streams", compression="zstd")
    wanted = dict(bucket_counts(packed_streams(target.withColumn("quern_no_id", F.lit(0)), buckets, "quern_no_id")).collect())
    gain = gains(dict(bucket_counts(streams).collect()), wanted, buckets)
    weighed = streams.mapInArrow(_weigh(docs.sparkSession.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")
    return draw(stash(with_scores(weighed), "weights"), fraction, least_words)


def sampled_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of docs that were drawn, with their rank; doc_ids that repeat stay together."""
    drawn = resampled.where("rank is not null").groupBy(F.col("doc_id").alias("quern_id")).agg(F.min("rank").alias("quern_rank"))
    return docs.join(drawn, F.col("doc_id") == F.col("quern_id")).drop("quern_id")


def digest(resampled: DataFrame) -> DataFrame:
    return resampled.select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """The digest for DuckDB, with crc32 written out over UTF-8 bytes."""
    grams = " UNION ALL ".join(f"SELECT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {{0}} WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
    words = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return rf"""
    WITH k AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
    d AS (SELECT doc_id, {words} AS w FROM documents),
    q AS (SELECT item_id AS doc_id, {words} AS w FROM benchmark),
    g AS ({grams.format("d")}),
    x AS ({grams.format("q")}),
    h AS (SELECT f, hex(encode(f)) AS z FROM (SELECT f FROM g UNION SELECT f FROM x)),
    y AS (SELECT f, list_prepend(4294967295, list_transform(range(length(z) // 2), lambda i: ('0x' || substr(z, 2 * i + 1, 2))::BIGINT)) AS b FROM h),
    c AS (SELECT f, xor(list_reduce(b, lambda c, e: xor(c >> 8, crc[1 + (xor(c, e) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM y, k),
    s AS (SELECT bucket, count(*) AS n FROM g JOIN c USING (f) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM x JOIN c USING (f) GROUP BY bucket),
    a AS (SELECT bucket, floor({SCALE} * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM g JOIN c USING (f) JOIN a USING (bucket) GROUP BY doc_id),
    p AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_words >= {LEAST_WORDS}),
    v AS (SELECT doc_id, rank FROM r WHERE rank <= (SELECT {FRACTION} * count(*) // 100 FROM r))
    SELECT p.doc_id, n_features, weight, score, v.rank FROM p LEFT JOIN v USING (doc_id)
    """


def brute_force(rows: list[tuple[int, str | None]], target: list[str | None], fraction: int = FRACTION, least_words: int = LEAST_WORDS) -> list[tuple]:
    """The digest by plain loops, for tests."""
    lower = {c: c + 32 for c in range(65, 91)}

    def features(text: str | None) -> tuple[int, list[int]]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    made = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + BUCKETS) / ((s[b] + 1) * (wanted + BUCKETS)))) for b in s}
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0], x[2], x[3]))
    rank = {id(x): i + 1 for i, x in enumerate(best[: fraction * len(best) // 100])}
    return [(d, f, w, s, rank.get(id(x))) for x in out for d, _, f, w, s in [x]]
