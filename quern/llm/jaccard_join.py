"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two documents are linked when the sets of their five-word shingles have a Jaccard similarity of at least 0.8.

1. Equal texts collapse into one entry with a number, by the 128-bit hash of the text: its copies are only counted, and
   doc_ids play no part until the end.
2. Every entry has BANDS x ROWS MinHash values; entries that agree in a whole band are candidates. A linked pair agrees
   in no band with a chance of (1 - 0.8**5)**40, about 1e-7. Bands that hold the same entries are kept once.
3. A bucket is dealt out in blocks of about BLOCK entries, fewer if their texts are long (WEIGHT shingles), and every two blocks of it meet in
   one task, so no task holds a whole bucket, and none more than two blocks of shingles. They meet as MinHash values only (16 bits each: two
   that differ seem equal with a chance of 2**-16, which only adds candidates). In the first bucket that both of a pair are in, the
   values are compared STEP at a time: with m of n equal and a flat prior, the similarity reaches t with a probability of
   P(Binomial(n + 1, t) <= m); the pair is dropped when that is under TOLERANCE.
4. A task says which of its entries have a pair left, not which pairs: one row for an entry and two blocks at most. The texts of these entries are
   fetched, the blocks meet again, pairs are pruned in the same way from the values that came along, and those that are left are
   verified exactly on the shingle sets. Pairs exist only inside a task.
5. Tasks return link counts and a spanning forest of the links they found; label propagation over the forest edges gives the classes.

Tables that are joined by a key which may be hot (equal texts, a large class) are written first, so that adaptive execution can
split such a key's rows.

Defined cases: null text is empty; a text of one to four words has one shingle, all its words; a text without words has
no links and a class of its own; copies (rows of equal text with a word) are linked to each other. Rows that repeat a
doc_id are rows like others, each with the class of its own text; a row whose doc_id is null too: class_id and copy_of are the
smallest doc_id that is there, null if there is none. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import released, runs, stash, texts_of, whole_text
from .wordgrid import scramble, window_codes, word_grid

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
STEP, TOLERANCE = 40, 1e-7
BLOCK, WEIGHT = 256, 1 << 20
#: Entries that a task compares in blocks, and the most tasks.
TASK, MOST_TASKS = 4_000, 20_000

SKETCH = "text_key binary, doc_id long, size int, bands array<long>, signature binary"


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text its sorted, distinct shingle codes."""
    for lo, hi in runs(texts):
        grid = word_grid(texts[lo:hi])
        codes, at = window_codes(grid, width)
        owner = grid.doc[at]
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        words = np.searchsorted(grid.doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if bounds[k] < bounds[k + 1]:
                yield np.unique(codes[bounds[k] : bounds[k + 1]])
            elif words[k] < words[k + 1]:  # fewer words than a shingle
                total = np.zeros(1, np.uint64)
                for c in grid.code[words[k] : words[k + 1]]:
                    total = total * np.uint64(3) + c
                yield scramble(total + np.uint64(words[k + 1] - words[k]))
            else:
                yield np.zeros(0, np.uint64)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = scramble(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32)[:, None], (seeds[n:] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(codes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of a shingle set that isn't empty."""
    mask, factor = _hash_family(n)
    low = (codes >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(best, ((low[k : k + 1024] ^ mask) * factor).min(axis=1), out=best)
    return best


def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The smallest m of n equal MinHash values for which the posterior of reaching the threshold isn't under the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sketch(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = scramble(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = scramble(np.arange(77, 77 + BANDS, dtype=np.uint64))
    for batch in source:
        sizes, keys, seen = [], [], []
        for codes in shingle_sets(texts_of(batch)):
            sizes.append(len(codes))
            if len(codes):
                values = signature(codes)
                bands = values.reshape(BANDS, ROWS).astype(np.uint64)
                keys.append(scramble((bands * weights).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                seen.append(values.astype(np.uint16).tobytes())
            else:
                keys.append(None)
                seen.append(None)
        made = [pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(seen, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("doc_id"), *made], ["text_key", "doc_id", "size", "bands", "signature"])


def _sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        sets = [s.tobytes() for s in shingle_sets(texts_of(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(sets, pa.binary())], ["entry", "codes"])


def _pairs_left(frame: pd.DataFrame, threshold: float, steps: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Of two blocks, sorted by block and entry: each row with those rows after it with which its pair isn't pruned."""
    band, left, right = (int(frame[c].iloc[0]) for c in ("band", "left_block", "right_block"))
    block, sizes = frame["block"].to_numpy(), frame["size"].to_numpy()
    minhash = np.stack([np.frombuffer(x, np.uint16) for x in frame["signature"]])
    buckets = np.zeros((len(frame), BANDS), np.int64)  # 0: in no bucket of that band, or the bucket isn't kept
    for i, (at, keys) in enumerate(zip(frame["bands"], frame["buckets"], strict=True)):
        buckets[i, at] = keys
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    for i in a:
        j = b[b > i] if left == right else b
        j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i])]
        j = j[((buckets[j] == buckets[i]) & (buckets[i] != 0)).argmax(axis=1) == band]  # else the pair belongs to an earlier bucket
        begin = 0
        for n, least in steps:
            if not len(j):
                break
            seen = (minhash[j, begin:n] == minhash[i, begin:n]).sum(axis=1)
            seen, begin = seen if begin == 0 else seen + so_far, n
            j, so_far = j[seen >= least], seen[seen >= least]
        if len(j):
            yield int(i), j


def _steps(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    return [(n, fewest_matches(n, threshold, tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def _prune_blocks(threshold: float, tolerance: float):
    steps = _steps(threshold, tolerance)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of two blocks: the entries that have a pair left."""
        frame = frame.sort_values(["block", "entry"], ignore_index=True)
        kept = np.zeros(len(frame), bool)
        for i, j in _pairs_left(frame, threshold, steps):
            kept[i] = True
            kept[j] = True
        return frame.loc[kept, ["bucket", "left_block", "right_block", "band", "block", "entry"]]

    return run


def _verify_blocks(threshold: float, tolerance: float):
    steps = _steps(threshold, tolerance)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of two blocks: for each entry with a link its links (copies counted) and the leader of its tree."""
        frame = frame.sort_values(["block", "entry"], ignore_index=True)
        entry, copies = frame["entry"].to_numpy(), frame["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in frame["codes"]]
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, partners in _pairs_left(frame, threshold, steps):
            for k in partners.tolist():
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if common >= threshold * (len(sets[i]) + len(sets[k]) - common):
                    links[i] += copies[k]
                    links[k] += copies[i]
                    x, y = top(i), top(k)
                    root[max(x, y)] = min(x, y)
        at = np.flatnonzero(links)
        leader: dict[int, int] = {}
        for i in at:
            leader[top(i)] = min(entry[i], leader.get(top(i), entry[i]))
        return pd.DataFrame({"member": entry[at], "links": links[at], "leader": [leader[top(i)] for i in at]}, columns=["member", "links", "leader"]).astype("int64")

    return run


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")


def link_blocks(rows: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """rows: those of keyed_rows. (entries, found): entries has entry, text_key, rep (the smallest doc_id) and copies of each
    text with words; found has member, links and leader of each pair of blocks with links."""
    sketches = rows.mapInArrow(released(_sketch), SKETCH).where("bands is not null")
    one = F.first(F.struct("size", "bands", "signature")).alias("s")  # the same in all rows of a text
    entries = sketches.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), one)
    entries = stash(entries.select(F.monotonically_increasing_id().alias("entry"), "text_key", "rep", "copies", "s.*"), "entries")
    dealt = entries.select("entry", "size", F.posexplode("bands").alias("band", "bucket"))
    alike = [F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("entry")).alias("x"), F.bit_xor(F.xxhash64("entry", F.lit(1))).alias("y")]
    shapes = dealt.groupBy("bucket").agg(*alike).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int").alias("blocks")
    shapes = stash(shapes.groupBy("n", "weight", "x", "y").agg(F.min("bucket").alias("kept")).select("kept", "n", blocks), "shapes")
    held = dealt.join(shapes, F.col("bucket") == F.col("kept")).groupBy("entry").agg(F.collect_list(F.struct("band", "bucket", "blocks")).alias("held"))  # at most BANDS
    held = held.withColumnRenamed("entry", "of").join(entries.select("entry", "size", "copies", "signature"), F.col("of") == F.col("entry"))
    held = stash(held.select("entry", "size", "copies", "signature", F.col("held.band").alias("bands"), F.col("held.bucket").alias("buckets"), "held"), "held")
    spread = held.select("entry", "size", "signature", "bands", "buckets", F.explode("held").alias("h")).withColumn("blocks", F.col("h.blocks"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(9)), F.col("blocks").cast("long")).cast("int"))
    spread = spread.select(
        F.col("h.bucket").alias("bucket"), F.col("h.band").alias("band"), "entry", "size", "signature", "bands", "buckets", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )  # fmt: skip
    spread = spread.select("*", F.least("block", "other").alias("left_block"), F.greatest("block", "other").alias("right_block")).drop("other")
    cell = ["bucket", "left_block", "right_block"]
    rows_met = shapes.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0)).alias("n")).first()["n"]
    spread = spread.repartition(min(MOST_TASKS, math.ceil(rows_met / TASK) + 1), *cell)  # much work for few bytes: by rows, not by size
    left = spread.groupBy(*cell).applyInPandas(_prune_blocks(threshold, tolerance), "bucket long, left_block int, right_block int, band int, block int, entry long")
    left = stash(left, "kept")
    wanted = stash(left.select(F.col("entry").alias("of")).distinct().join(entries.select("entry", F.col("text_key").alias("of_key"), "rep"), F.col("of") == F.col("entry")).drop("of"), "wanted")
    wanted = wanted.hint("merge")  # shuffled at every size: a plan that changed with the size would shuffle more than in proportion
    texts = rows.join(wanted, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = texts.groupBy("entry").agg(F.first("text").alias("text"))  # rows may repeat, with equal text
    sets = texts.mapInArrow(released(_sets), "entry long, codes binary").select(F.col("entry").alias("of"), "codes")
    whole = sets.join(held.drop("held"), F.col("of") == F.col("entry")).drop("entry")
    met = left.join(whole, F.col("entry") == F.col("of")).drop("of")
    met = met.repartition(min(MOST_TASKS, math.ceil(left.count() / TASK) + 1), *cell)
    found = met.groupBy(*cell).applyInPandas(_verify_blocks(threshold, tolerance), "member long, links long, leader long")
    return entries, stash(found, "links")


def _classes(edges: DataFrame) -> DataFrame:
    """(member, leader) of every member: the smallest entry that it is connected to.

    Each round moves every edge to the smallest leader that its ends know of; it ends when no label changes.
    """
    labels = stash(edges.groupBy("member").agg(F.min("leader").alias("leader")), "labels")
    last = None
    while True:
        state = labels.agg(F.sum(F.col("leader").cast("decimal(38,0)")).alias("s")).first()["s"]
        if state == last:
            return labels
        last = state
        known = labels.select(F.col("member").alias("m"), F.col("leader").alias("at"))
        ends = edges.join(known, F.col("member") == F.col("m")).select("member", F.col("leader").alias("hub"), "at")
        hubs = ends.groupBy("hub").agg(F.min("at").alias("least"))
        hubs = stash(hubs.join(known, F.col("hub") == F.col("m"), "left").select("hub", F.least("least", F.coalesce("at", "hub")).alias("least")), "hubs")
        own = hubs.select(F.col("hub").alias("member"), "least")
        back = edges.select("member", "leader").join(hubs, F.col("leader") == F.col("hub")).select("member", "least")
        jump = known.alias("p").join(known.alias("q"), F.col("p.at") == F.col("q.m")).select(F.col("p.m").alias("member"), F.col("q.at").alias("least"))
        labels = stash(back.unionByName(own).unionByName(jump).groupBy("member").agg(F.min("least").alias("leader")), "labels")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id that links lead to), copy_of (the smallest
    doc_id of equal text), n_copies (rows of equal text, itself included), n_links (other rows it is linked to)."""
    rows = keyed_rows(docs)
    entries, found = link_blocks(rows, threshold, tolerance)
    counts = found.groupBy("member").agg(F.sum("links").alias("links"))
    classes = _classes(stash(found.select("member", "leader").distinct(), "edges"))
    linked = counts.join(classes, "member")
    known = entries.select("entry", "text_key", "rep", "copies").join(linked, F.col("entry") == F.col("member"), "left")
    known = stash(known.select("text_key", "rep", "copies", F.coalesce("leader", "entry").alias("leader"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    least = stash(known.groupBy(F.col("leader").alias("of_leader")).agg(F.min("rep").alias("class_id")), "classes")
    known = known.join(least, F.col("leader") == F.col("of_leader")).select(F.col("text_key").alias("of_key"), "rep", "copies", "class_id", "links")
    known = stash(known, "texts")
    return rows.select("doc_id", "text_key").join(known, F.col("text_key") == F.col("of_key"), "left").select(
        "doc_id",
        F.when(F.col("of_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("of_key").isNull(), F.col("doc_id")).otherwise(F.col("rep")).alias("copy_of"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same for DuckDB, by all pairs that share a shingle."""
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	

]+'), lambda x: x <> '') AS w FROM documents),
    e AS (SELECT t, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY t),
    s AS (SELECT rep, copies, list_distinct(CASE WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' ')) END) AS g FROM e),
    x AS (SELECT rep, unnest(g) AS g FROM s),
    c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
    l AS (SELECT a, b, p.copies AS ca, q.copies AS cb FROM c JOIN s p ON p.rep = a JOIN s q ON q.rep = b WHERE n >= {threshold}::DOUBLE * (len(p.g) + len(q.g) - n)),
    h AS (SELECT a, b, cb AS k FROM l UNION ALL SELECT b, a, ca FROM l),
    r AS (SELECT rep AS a, rep AS b FROM e UNION SELECT r.a, h.b FROM r JOIN h ON r.b = h.a),
    k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
    m AS (SELECT a, sum(k) AS links FROM h GROUP BY a)
    SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(e.rep, d.doc_id) AS copy_of, coalesce(e.copies, 1)::BIGINT AS n_copies,
        coalesce(m.links + e.copies - 1, e.copies - 1, 0)::BIGINT AS n_links
    FROM d LEFT JOIN e ON e.t = d.t LEFT JOIN k ON k.a = e.rep LEFT JOIN m ON m.a = e.rep
    """


def brute_force(rows: list[tuple[int, str | None]], threshold: float = THRESHOLD, width: int = WIDTH) -> list[tuple]:
    """The same by comparing all pairs, for tests; doc_ids are distinct and not null."""
    sets: dict = {}
    for d, t in rows:
        w = (t or "").encode().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    text, ids = dict(rows), sorted(sets)
    group, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                    links[x] += 1
                    links[y] += 1
                    a, b = sorted((top(x), top(y)))
                    group[b] = a
    same = {}
    for d in ids:
        if sets[d]:
            same.setdefault(text[d], []).append(d)
    return [(d, top(d), same.get(text[d], [d])[0], len(same.get(text[d], [d])), links[d]) for d in ids]
