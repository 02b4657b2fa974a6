import random

import numpy as np
import pytest

from quern.llm import jaccard_join as m

SCHEMA = "doc_id long, text string, links string"


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(6, 160))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n := n + rng.randint(1, 9), " ".join(words)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1].replace(" ", "\n")), (n + 3, ""), (n + 4, None), (n + 5, "one"), (n + 6, "one"), (n + 7, "one two"), (n + 8, " ")]
    return rows


def test_matches_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in m.near_duplicates(df).collect()) == sorted(m.brute_force(rows))


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(m, "BLOCK", 7)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in m.near_duplicates(df).collect()) == sorted(m.brute_force(rows))


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text, ""), (1, text, ""), (1, text, ""), (4, "other words stand here", ""), (None, "of no number at all", ""), (None, None, ""), (5, "", "")], SCHEMA)
    got = sorted((tuple(r) for r in m.near_duplicates(df).collect()), key=str)
    want = [(None, 1, 1, 3, 2), (1, 1, 1, 3, 2), (1, 1, 1, 3, 2), (4, 4, 4, 1, 0), (None, None, None, 1, 0), (None, None, None, 1, 0), (5, 5, 5, 1, 0)]
    assert got == sorted(want, key=str)
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_a_doc_id_with_two_texts_loses_no_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a, ""), (1, b, ""), (7, b + " more", ""), (8, a + " more", ""), (9, "z", "")], SCHEMA).repartition(3)
    for _ in range(2):
        got = sorted(tuple(r) for r in m.near_duplicates(df).collect())
        assert got == [(1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (7, 1, 7, 1, 1), (8, 1, 8, 1, 1), (9, 9, 9, 1, 0)]


def test_sql_says_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(d, t, "x") for d, t in near_copies(9)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(m.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in m.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()) == want


def test_minhash_estimates_the_similarity_and_pruning_is_rare():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        both, only = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
        x, y = m.signature(np.r_[both, only[:50]]), m.signature(np.r_[both, only[50:]])
        errors.append((x == y).mean() - 400 / 500)
        assert all((x[:n] == y[:n]).sum() >= m.fewest_matches(n) for n in range(40, 201, 40))
    assert abs(np.mean(errors)) < 0.02


def test_what_tasks_return_grows_with_entries_and_blocks_not_with_pairs(spark, monkeypatch):
    """Near copies of one text: no table on the way holds a row, or a list, of their pairs."""
    written = {}
    whole = m.stash

    def watched(df, name, **more):
        out = whole(df, name, **more)
        written[name] = (out.count(), sum(len(str(r)) for r in out.select(*[c for c in out.columns if c not in ("signature", "bands")]).collect()))
        return out

    monkeypatch.setattr(m, "stash", watched)
    base = [f"w{i}" for i in range(300)]
    sizes = {}
    for n in (200, 400):
        rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(n) for k in [(i * 7) % 300]]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = {r.doc_id: (r.class_id, r.n_links) for r in m.near_duplicates(df).collect()}
        assert out == dict.fromkeys(range(n), (0, n - 1))
        sizes[n] = dict(written)
    for name in ("held", "kept", "wanted", "links"):
        blocks = 2  # 200 entries are one block, 400 are two: each entry meets both
        assert all(sizes[400][name][k] <= 2.2 * blocks * sizes[200][name][k] for k in (0, 1)), name
    assert sizes[400]["kept"][0] < 50 * 400


def test_long_texts_are_dealt_in_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "WEIGHT", 500)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(12) for k in [i * 20]]
    held = []
    whole = m.stash
    monkeypatch.setattr(m, "stash", lambda df, name, **k: (held.append((name, whole(df, name, **k))) or held[-1][1]))
    got = sorted(tuple(r) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(m.brute_force(rows))
    kept = next(t for n, t in held if n == "kept")
    assert kept.agg({"right_block": "max"}).first()[0] >= 7  # 12 texts of about 400 shingles over blocks of 500
