import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.llm import substring_dedup as m

SCHEMA = "doc_id long, text string, part int, places string"


def rows_for_test():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "x y", " "]
    shared = [" ".join(rng.choices(vocabulary, k=n)) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(60):
        bits = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(3)]
        bits.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "\t  "]).join(bits)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (502, None), (503, ""), (504, " \n"), (505, "one"), (506, "a " * 40), (507, "a " * 13)]
    rows += [(600, " ".join(f"long{i % 977}" for i in range(30000)))]
    rows += [(601, rows[-1][1] + " tail")]
    return rows


def test_matches_plain_loops(spark):
    rows = rows_for_test()
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in m.digest(m.remove_repeats(df)).collect())
    assert got == sorted(m.brute_force(rows))


def test_small_batches_give_the_same(spark, monkeypatch):
    rows = rows_for_test()
    monkeypatch.setattr(m, "COMBINE", 500)
    monkeypatch.setattr(m, "BATCH", 70)
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in m.digest(m.remove_repeats(df)).collect())
    assert got == sorted(m.brute_force(rows))


def test_sql_says_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows_for_test()], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(m.oracle_sql()).fetchall()) == sorted(tuple(r) for r in m.digest(m.remove_repeats(df)).collect())


def test_rows_that_share_a_doc_id_keep_their_own_words(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, text + " x"), (2, "of its own " + text), (2, "quite another one " * 6)] + [(3, text)] * 3
    got = sorted((r.doc_id, r.kept) for r in m.remove_repeats(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)).collect())
    assert got == [(1, text), (2, "of its own"), (2, ("quite another one " * 6).strip()), (2, "x"), (3, ""), (3, ""), (3, "")]


def test_intervals_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, 0, ""), (2, "start " + text + " end", 0, ""), (None, text, 0, "")], SCHEMA)
    out = {r.doc_id: r for r in m.remove_repeats(df).collect()}
    assert out[1].n_removed == 0 and out[None].n_removed == 0
    assert out[2].intervals == [[1, 21]] and out[2].kept == "start end"
    assert m.remove_repeats(df.limit(0)).count() == 0


def test_a_window_that_fills_a_text_is_one_row_for_its_code(spark):
    """Two texts of equal words: each task sends one row for the code, whatever the length."""
    rows = [(d, "same " * 300_000) for d in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    windows = m._rows(df).mapInArrow(m._windows(m.WIDTH, m.crowded(m._rows(df))), m.WINDOWS)
    sent = windows.where("end is null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.size("codes")).alias("codes")).collect()
    assert len(sent) == 1 and sent[0].n == sent[0].codes <= 2 and windows.count() <= 4
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in m.remove_repeats(df).collect())
    assert got == [(1, 300_000, 0), (2, 300_000, 300_000)]


def test_crowded_buckets_change_no_result(spark, monkeypatch):
    """A header of twelve words that all texts share fills the buckets of its sequences; these windows are dealt by code."""
    rng = random.Random(5)
    rows = [(i, "this is the one long header that stands over all our pages " + " ".join(f"v{rng.randrange(5000)}" for _ in range(40))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    crowd = m.crowded(df)
    assert 0 < len(crowd) < m.SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {}
    for name, buckets in (("found", crowd), ("none", crowd[:0])):
        monkeypatch.setattr(m, "crowded", lambda docs, width, buckets=buckets: buckets)
        got[name] = sorted(tuple(r) for r in m.digest(m.remove_repeats(df)).collect())
    assert got["found"] == got["none"] == sorted(m.brute_force(rows))
    limit = 230 * 40 / (m.SHARE * int(spark.conf.get("spark.sql.shuffle.partitions")))  # 230 texts of 40 windows
    most = {}
    for name, buckets in (("found", crowd), ("none", crowd[:0])):
        windows = m._unfolded(m._rows(df).mapInArrow(m._windows(m.WIDTH, buckets), m.WINDOWS))
        most[name] = windows.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most["found"] <= limit < most["none"]


def test_windows_meet_by_bucket_without_a_further_exchange(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    windows = m._unfolded(m._rows(df).mapInArrow(m._windows(m.WIDTH, m.crowded(df)), m.WINDOWS))
    plan = windows.withColumn("least", F.min("doc").over(Window.partitionBy("code", "bucket")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_buckets_are_least_hashes_of_the_sequences_in_a_window():
    grid = m.word_grid([b" ".join(b"w%d" % (i % 37) for i in range(90)), b"x y z"])
    for width in (1, 3, 4, 5, 13, 40):
        gram = min(m.GRAM, width)
        hashes = m.window_codes(m.WordGrid(grid.doc * 0, grid.code), gram)[0]
        plain = [int(min(hashes[i : i + width - gram + 1])) >> 33 for i in range(len(hashes) - width + gram)]
        assert m._buckets(grid, width).tolist() == plain
