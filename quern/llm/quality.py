"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and pairs of adjacent words are hashed into BUCKETS. The raw multinomial counts the n-grams of every document. The
target multinomial counts those of trusted documents: rows of `labels` with quality 1 and toxic 0, all of them (TRUSTED is
no bound; `fit` takes one), of which three quarters by a hash of doc_id are counted. A bucket weighs
log((target + PRIOR) / (raw * share + PRIOR)), where share scales the raw counts to the target's size; a document scores
the mean weight of its n-grams. The threshold is the REJECT quantile of the scores of the trusted documents that were not
counted (those that were score too well to say what others get), in steps of 1 / GRID, so that the same tables always
give the same verdicts. A document is kept if its score reaches the threshold
and the base rules hold (at least 50 words, and at most half of them in three-word windows that occur twice).

Everything is DataFrame functions. The texts of three quarters of the documents are shuffled once, by doc_id, to meet the
trusted ids; besides these only scores and bucket counts travel, which have at most BUCKETS keys after each task has added
up its own. The weights are a table of one row that plans read by a scalar subquery: as a constant they would stand, as
text and as 65,536 objects, in every copy of the plan that the driver makes, describes and sends.

Defined cases: null text has no words, scores 0 and fails the base rules; without trusted documents all weights are 0
and the threshold is lowest, so only the base rules decide; rows are judged each by itself, so repeated rows and null doc_ids
get a verdict each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import BLANKS, stash, whole_text

BUCKETS, PRIOR = 65536, 5.0
TRUSTED, REJECT, GRID, LOWEST = None, 0.005, 1000, -20.0
MIN_WORDS, MAX_REPEAT = 50, 50  # per cent


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t\n\x0b\f\r]+"), "")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with quern_text and quern_words; a column used more than once isn't computed again for each use."""
    return docs.withColumn("quern_text", whole_text(text)).withColumn("quern_words", words_of(F.col("quern_text")))


def _follows(array: Column, by: int) -> Column:
    """The array without its first elements."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _pairs(words: Column, made) -> Column:
    """What `made` gives for each two adjacent words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), _follows(words, 1), made)


def bucket_list(words: Column) -> Column:
    """Buckets of all words, then of all pairs of adjacent words."""
    return F.concat(F.transform(words, lambda w: bucket(w)), _pairs(words, lambda a, b: bucket(a, b)))


def base_measures(docs: DataFrame) -> DataFrame:
    """docs (with quern_text and quern_words) and the base columns."""
    text, words = F.col("quern_text"), F.col("quern_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    windows = F.greatest(F.size(words) - 2, F.lit(0))
    out = docs.select(
        "*",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("quern_lines"),
        F.slice(F.transform(words, lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2))), 1, windows).alias("quern_codes"),
    )
    codes = F.col("quern_codes")
    # Windows that occur twice: sorted by code and place, a window whose neighbour has its code.
    ranked = F.when(F.size(F.array_distinct(codes)) < F.size(codes), F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i")))))
    out = out.withColumn("quern_ranked", ranked)
    ranked = F.col("quern_ranked")
    same = F.zip_with(ranked, _follows(ranked, 1), lambda a, b: F.coalesce(a.c == b.c, F.lit(False)))
    out = out.withColumn("quern_same", same)
    same = F.col("quern_same")
    twice = F.zip_with(ranked, F.zip_with(same, F.concat(F.array(F.lit(False)), F.slice(same, 1, F.greatest(F.size(same) - 1, F.lit(0)))), lambda x, y: x | y), lambda a, x: F.when(x, a.i))
    out = out.withColumn("quern_twice", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    twice = F.col("quern_twice")
    reach = F.zip_with(twice, _follows(twice, 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return out.select(
        *docs.columns,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("quern_lines") - F.size(F.array_distinct("quern_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _trusted(labels: DataFrame, bound: int | None) -> DataFrame:
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("quern_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = good.where("quality = 1 and toxic = 0")
    good = good if bound is None else good.orderBy(F.xxhash64("quern_id"), "quern_id").limit(bound)
    return good.select("quern_id")


def _fitted(doc_id: Column) -> Column:
    """Whether a document is counted if it is trusted; else it sets the threshold if it is."""
    return F.coalesce(doc_id.isNotNull() & (F.pmod(F.xxhash64(doc_id), F.lit(4)) != 0), F.lit(False))


def _weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (with quern_words) and llr, the mean weight of a document's n-grams."""
    met = rows.withColumn("quern_weights", weights.scalar())  # a column, as subqueries may not stand in lambda functions
    return met.withColumn("llr", _score(F.col("quern_words"), F.col("quern_weights"))).drop("quern_weights")


def _score(words: Column, weights: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.get(weights, bucket(w)))
    total = F.aggregate(_pairs(words, lambda a, b: F.get(weights, bucket(a, b))), total, lambda s, x: s + x)
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(F.lit(0.0))


class Model:
    """Weights of the buckets (a table of one row, which holds an array) and the threshold."""

    def __init__(self, weights: DataFrame, threshold: float):
        self.weights, self.threshold = weights, threshold


def _weights(spark: SparkSession, counts: DataFrame) -> tuple[DataFrame, int]:
    """The weights, all 0 without trusted documents, and the n-grams of these. counts: bucket, raw and target."""
    bucket, raw, target = (c.to_pylist() for c in counts.select("bucket", "raw", "target").toArrow().columns)
    n, m = sum(raw), sum(target)
    weights = [0.0] * BUCKETS
    if m:
        for b, r, t in zip(bucket, raw, target, strict=True):
            weights[b] = round(math.log((t + PRIOR) / (r * m / n + PRIOR)), 6)
    return stash(spark.createDataFrame([(weights,)], "weights array<double>").coalesce(1), "weights"), m


def _flagged(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """text of every document, and whether it is trusted and counted.

    Only texts that are counted if trusted meet the ids, in a shuffle at any size: a broadcast of the ids would grow with the table.
    """
    fitted = _fitted(F.col("doc_id"))
    ids = trusted.where(_fitted(F.col("quern_id"))).hint("shuffle_hash")
    met = rows.where(fitted).join(ids, F.col("doc_id") == F.col("quern_id"), "left").select("text", F.col("quern_id").isNotNull().alias("trusted"))
    return met.unionAll(rows.where(~fitted).select("text", F.lit(False).alias("trusted")))


def fit(docs: DataFrame, labels: DataFrame, bound: int | None = TRUSTED, reject: float = REJECT) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = _trusted(labels, bound)
    counts = with_words(_flagged(rows, trusted)).select("trusted", F.explode(bucket_list(F.col("quern_words"))).alias("bucket"))
    weights, target = _weights(docs.sparkSession, counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target")))
    if not target:
        return Model(weights, LOWEST)
    # The others are scored first, so that what meets the ids is a number, not a text.
    others = with_words(rows.where(~_fitted(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    scored = _weighed(others, weights).select("doc_id", F.floor(F.col("llr") * GRID).cast("int").alias("step"))
    steps = scored.join(trusted, F.col("doc_id") == F.col("quern_id")).groupBy("step").count().collect()
    left = reject * sum(r["count"] for r in steps)
    for r in sorted(steps):  # at most 2 * GRID * |largest weight| steps
        if left < r["count"]:
            return Model(weights, r["step"] / GRID)
        left -= r["count"]
    return Model(weights, LOWEST)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("quern_row"), F.col("text").alias("quern_source"))
    out = base_measures(with_words(rows, "quern_source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = _weighed(out.withColumn("base_failed", failed), model.weights)
    # A filter on the verdict must not be pushed below this point: there it would repeat, for every use, what it rests on.
    # An expression of its own for each row keeps it above.
    out = out.withColumn("quern_fence", F.monotonically_increasing_id())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= model.threshold) & (F.col("quern_fence") >= 0))
    return out.drop("quern_words", "quern_text", "quern_source", "quern_fence")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        F.col("quern_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 4).alias("llr")
    )


def brute_force(rows: list[tuple[int, str | None]], labels: list[tuple[int, int, int]], bound: int | None = TRUSTED, reject: float = REJECT) -> list[tuple]:
    """The same by plain loops, for tests; doc_ids are distinct."""
    import xxhash

    def code(parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    good: dict[int, list] = {}
    for d, q, t in labels:
        good.setdefault(d, []).append((q, t))
    chosen = [d for d, x in good.items() if min(q for q, _ in x) == 1 and max(t for _, t in x) == 0]
    chosen = set(sorted(chosen, key=lambda d: (signed(code([d.to_bytes(8, "little", signed=True)])), d))[:bound])
    fitted = {d for d in chosen if code([d.to_bytes(8, "little", signed=True)]) % 4}
    words = {d: (t or "").encode().split() for d, t in rows}
    grams = {d: [signed(code(g)) % BUCKETS for g in [*zip(w), *zip(w, w[1:])]] for d, w in words.items()}
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for d, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += d in fitted
    n, m = sum(raw), sum(target)
    weights = [round(math.log((t + PRIOR) / (r * m / n + PRIOR)), 6) if m and r else 0.0 for r, t in zip(raw, target)]
    score = {d: sum(weights[b] for b in g) / len(g) if g else 0.0 for d, g in grams.items()}
    steps = sorted(math.floor(score[d] * GRID) for d in chosen - fitted if d in score)
    threshold = steps[int(reject * len(steps))] / GRID if steps and m else LOWEST
    out = []
    for d, t in rows:
        t, w = t or "", words[d]
        seen: dict = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeat = len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)})
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        failed = len(w) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(w)
        out.append((d, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed, not failed and score[d] >= threshold))
    return out
