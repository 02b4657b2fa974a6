import random

import numpy as np
import pytest

from quern.llm import importance as m

SCHEMA = "doc_id long, text string, weight int, rank string"


def rows_for_test():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünder", "naïve", "A-b", "3.5", "日本", "\x00", "_x_"]
    rows = [(i * 7 - 30, rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(3000, rows[5][1]), (3001, None), (3002, ""), (3003, "one"), (3004, "one two"), (3005, " .,; "), (3006, "z " * 30)]
    target = [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(12)] + [None, ""]
    return rows, target


def frames(spark, rows, target):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


def test_matches_plain_loops(spark):
    rows, target = rows_for_test()
    got = sorted(tuple(r) for r in m.digest(m.resample(*frames(spark, rows, target))).collect())
    want = sorted(m.brute_force(rows, target))
    assert [tuple(-1 if v is None else v for v in r) for r in got] == [tuple(-1 if v is None else v for v in r) for r in want]
    assert sum(r[4] is not None for r in got) >= 5


def test_small_streams_give_the_same(spark, monkeypatch):
    rows, target = rows_for_test()
    whole = sorted(map(str, m.digest(m.resample(*frames(spark, rows, target))).collect()))
    monkeypatch.setattr(m, "STREAM", 40)
    assert sorted(map(str, m.digest(m.resample(*frames(spark, rows, target))).collect())) == whole


def test_long_texts_are_hashed_in_parts_alike(monkeypatch):
    text = ("Some words, naïve and 日本 again " * 60_000).encode()
    n, stream = m.text_buckets(text)
    words = m.WORD.findall(text.lower())
    assert n == len(words) and len(stream) == 3 * n - 3
    plain = [m.crc32(b" ".join(words[i : i + k])) % m.BUCKETS for k in (1, 2, 3) for i in range(n - k + 1)]
    assert (np.bincount(stream, minlength=m.BUCKETS) == np.bincount(plain, minlength=m.BUCKETS)).all()


def test_target_like_documents_are_drawn_more_often(spark):
    rng = random.Random(1)
    common, wanted = [f"c{i}" for i in range(50)], [f"t{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(wanted if i % 10 == 0 else common, k=40))) for i in range(400)]
    out = m.resample(*frames(spark, rows, [" ".join(wanted)] * 3), fraction=10)
    drawn = [r.doc_id for r in out.where("rank is not null").orderBy("rank").collect()]
    assert len(drawn) == 40 and sum(d % 10 == 0 for d in drawn) > 35
    docs, _ = frames(spark, rows, [])
    assert sorted(r.doc_id for r in m.sampled_documents(docs, out).collect()) == sorted(drawn)


def test_null_ids_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs, target = frames(spark, [(None, text), (1, text), (1, text + " more"), (2, None)] + [(10 + i, text) for i in range(40)], [text])
    out = m.resample(docs, target, fraction=50).collect()
    assert len(out) == 44 and [r for r in out if r.doc_id is None][0].score is None
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 22))
    assert m.resample(docs.limit(0), target).count() == 0
    assert m.resample(docs, target.limit(0)).where("weight is null").count() == 0


def test_sql_says_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, target = frames(spark, *rows_for_test())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, con.sql(m.oracle_sql()).fetchall())) == sorted(str(tuple(r)) for r in m.digest(m.resample(docs, target)).collect())
