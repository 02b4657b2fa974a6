"""Spelling variants: words one edit apart, found by range scans of a forward and a reversed sorted dictionary.

1. Each task counts the words of its texts; the counts meet by word, which gives the dictionary. Words are runs of letters up to U+00FF, so a
   word is one byte a letter in Latin-1, and byte order is code-point order.
2. Let w be the shorter of two words one edit apart, m its length, and p the length of their common prefix: p says where the edit is. If p is
   in an interval [lo, hi), both share their first lo letters and their last m - hi. Cut in the middle this gives two blocks: words that share
   the first half (neighbours in the forward dictionary, sorted by word) and words that share the second half (neighbours in the reversed one).
   A word stands in the blocks of m = its own length and of m = one less.
3. Blocks are counted before any of their words are moved. In a block of over BLOCK words the interval is cut in half again, which makes the
   shared prefix or suffix longer; with one place left, the alphabet bounds the block. So no block is large whatever the words, no pair is lost,
   and each is in one block only, that of its p.
4. Tasks get the words sorted by block, scan one range of equal block keys after the other and verify: p and the common suffix s of a pair are
   measured, and they are one edit apart if p + s covers all of w but the edit. For each word a block returns the number of its near words and
   the best of them, never the pairs.
5. A word's form is its best near word if that is MARGIN times as frequent. Roots follow forms by pointer doubling.

Defined cases: null text has no words; a null doc_id counts as an empty one; rows that repeat a doc_id are rows like others; words that occur once
or are shorter than SHORTEST are left out, as in the contract; long words (over WIDE letters) are verified one pair after the other; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut_at, stash, texts_of, whole_text

SHORTEST, LEAST_N, MARGIN, SLIP = 7, 2, 10, 31
#: Words of a block that are compared with each other.
BLOCK = 256
#: Distinct words that a task counts before it hands them on; letters of words that are compared as rows of a matrix; pairs at a time.
HELD, WIDE, PAIRS = 300_000, 40, 1 << 17
LETTERS = re.compile("[a-z\xc0-\xff]+")
LONG_RUN = re.compile("[a-z\xc0-\xff]{%d,}" % SHORTEST)  # shorter runs can't become words


def text_words(doc: int | None, text: bytes) -> Counter:
    """The words of one text, with slips applied, and their numbers."""
    runs: Counter = Counter()
    for piece in cut_at(text.lower().decode("utf-8", "replace"), LETTERS):  # lower() of bytes changes A-Z only
        runs.update(LONG_RUN.findall(piece))
    head, out = crc32(b"%d:" % doc if doc is not None else b":"), Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), head)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            out[run] += n
    return out


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in source:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                held.update(text_words(doc, text))
                if len(held) >= HELD:
                    yield made()
                    held.clear()
    if held:
        yield made()


def dictionary(docs: DataFrame, least: int = LEAST_N) -> DataFrame:
    """word, n of all words that occur often enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _block_key() -> Column:
    """Words of one m and interval that share the prefix and the suffix get one key. (Two blocks whose keys collide are scanned as
    one, which only adds comparisons: pairs are verified, and the interval is compared too.)"""
    tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return F.xxhash64("m", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.right(F.col("word"), tail))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its interval."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return rows.select("word", "n", "m", F.explode(halves).alias("cut")).select("word", "n", "m", "cut.lo", "cut.hi")


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """words: word, n. word, n, m, lo, hi, key: each word in every block that may hold a near word."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    rows = _halved(rows.select("word", "n", "m", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi")))
    done = []
    while True:
        rows = rows.withColumn("key", _block_key())
        paired = (F.count("*") > 1) & F.max(F.length("word") == F.col("m"))  # else no word of it is the shorter one of a pair
        counts = rows.groupBy("key").agg((F.count("*") > limit).alias("large"), F.max(F.col("hi") - F.col("lo")).alias("width"), paired.alias("paired"))
        counts = stash(counts.where("paired").select(F.col("key").alias("of_key"), "large", "width"), "blocks")
        at = F.col("key") == F.col("of_key")
        done.append(rows.join(counts.where("not large or width = 1"), at, "left_semi"))
        large = counts.where("large and width > 1")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        rows = _halved(stash(rows.join(large, at, "left_semi").drop("key"), "large"))


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the words as rows of bytes from the left and reversed; the padding of no two words' ends is equal to a letter."""
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max()) + 1
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    right = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return sizes, left, right


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows."""
    differs = a != b
    return np.where(differs.any(axis=1), np.minimum(differs.argmax(axis=1), most), most)


def _near_pairs(words: list[bytes], key: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs one edit apart in rows sorted by key; a pair comes once, in the interval of its common prefix."""
    sizes, left, right = _matrices([w if len(w) <= WIDE else b"" for w in words])
    sizes = np.array([len(w) for w in words])
    last = np.searchsorted(key, key, "right")
    far = int((last - np.arange(len(key))).max(initial=0))
    for step in range(1, far):
        whole = np.flatnonzero(np.arange(step, len(key) + step) < last)
        for k in range(0, len(whole), PAIRS):
            i = whole[k : k + PAIRS]
            j = i + step
            short, gap = np.minimum(sizes[i], sizes[j]), np.abs(sizes[i] - sizes[j])
            alike = (m[i] == m[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j]) & (short == m[i]) & (gap <= 1)
            i, j, short, gap = i[alike], j[alike], short[alike], gap[alike]
            p, s = _common(left[i], left[j], short), _common(right[i], right[j], short)
            for x in np.flatnonzero(short >= WIDE):
                p[x], s[x] = _long_common(words[i[x]], words[j[x]])
            near = (p + s >= short - (gap == 0)) & (lo[i] <= p) & (p < hi[i]) & ((gap == 1) | (p < short))
            yield i[near], j[near]


def _long_common(a: bytes, b: bytes) -> tuple[int, int]:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    front, back = np.flatnonzero(x[:n] != y[:n]), np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    return int(front[0]) if len(front) else n, int(back[0]) if len(back) else n


def _scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: for each word of a block its near words counted, and the best of them."""

    def scanned(t: pa.Table) -> Iterator[pa.RecordBatch]:
        words = [w.encode("latin-1") for w in t.column("word").to_pylist()]
        n, key, m, lo, hi = (t.column(c).to_numpy() for c in ("n", "key", "m", "lo", "hi"))
        found = [np.concatenate(x) for x in zip(*[(np.concatenate([i, j]), np.concatenate([j, i])) for i, j in _near_pairs(words, key, m, lo, hi)], strict=True)]
        if found and len(found[0]):
            of, near = found
            order = np.empty(len(words), np.int64)
            order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            by = np.lexsort((order[near], -n[near], of))
            of, near = of[by], near[by]
            head, first = np.unique(of, return_index=True)
            best = near[first]
            names = ["word", "n_near", "best_n", "best"]
            columns = [pa.array([words[k].decode("latin-1") for k in head]), pa.array(np.diff(first, append=len(of))), pa.array(n[best]), pa.array([words[k].decode("latin-1") for k in best])]
            yield pa.RecordBatch.from_arrays(columns, names)

    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        begin = int(np.searchsorted(key, key[-1], "left"))  # the last block may go on
        if begin or (held and held[-1].column("key")[-1].as_py() != key[0]):
            yield from scanned(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        held.append(batch.slice(begin))
    if held:
        yield from scanned(pa.Table.from_batches(held))


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """word, n_near, best (struct of the negative n and the word): of words that have a near word."""
    rows = blocks(words, limit)
    dealt = rows.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least)


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word, root for every word with a form: the end of its chain. A form is MARGIN times as frequent as
    its word, so chains are short; each round doubles what a step covers, until no root has a form itself."""
    steps = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stash(steps.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return steps
        steps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, limit: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stash(dictionary(docs), "dictionary")
    near = near_words(words, limit).withColumnRenamed("word", "of_word")
    known = words.join(near, F.col("word") == F.col("of_word"), "left")
    found = -F.col("best.minus")
    enough = found >= margin * F.col("n")
    known = stash(known.select("word", "n", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, found).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "forms")
    ends = roots(known.where("form is not null").select("word", "form")).withColumnRenamed("word", "of_word")
    out = known.join(ends, F.col("word") == F.col("of_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same for DuckDB: crc32 written out, near words by what is left when one letter goes."""
    bytes_of = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))"
    return rf"""
    WITH RECURSIVE k AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    o AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {SHORTEST} GROUP BY ALL),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, {bytes_of.format("doc_id || ':' || run")}), lambda c, e: xor(c >> 8, crc[1 + (xor(c, e) & 255)])), 4294967295) AS h FROM o, k),
    s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST_N}),
    v AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
    p AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
        UNION SELECT v.word, w.word FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.rest = w.word),
    c AS (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = b GROUP BY a),
    f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {MARGIN} * n THEN best END AS form, CASE WHEN best_n >= {MARGIN} * n THEN best_n END AS form_n FROM w LEFT JOIN c ON a = word),
    t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
    e AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
    """


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same by comparing all words, for tests."""
    lower = {c: c + 32 for c in range(65, 91)}
    count: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, numbers = {}, {}
    for w, n in words.items():
        found = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        numbers[w], form[w] = len(found), best if best and words[best] >= 10 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], numbers[w], words[form[w]] if form[w] else None))
    return out
