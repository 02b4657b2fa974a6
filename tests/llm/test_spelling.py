import random

import pytest

from quern.llm import spelling as m

SCHEMA = "doc_id long, text string, word string, n int"


def rows_for_test(seed=5, n=120):
    rng = random.Random(seed)
    letters = "abcdeé÷ÿ"
    stems = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(25)] + ["a" * 7, "a" * 8, "a" * 9, "b" * 60, "b" * 61, "ab" * 20, "ab" * 20 + "a"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = list(rng.choice(stems[: 1 + rng.randrange(len(stems))]))
            if rng.random() < 0.3:
                k, what = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + (what > 0)] = [rng.choice(letters)] if what < 2 else []
            word = "".join(w)
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i - 5, rng.choice([" ", "-", "1"]).join(words)))
    many = ["pre" + a + b + "fix" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows += [(700, " ".join(many * 2)), (701, " ".join(x + "s" for x in many * 2)), (702, None), (703, ""), (704, "short"), (None, "edoution edoution"), (700, rows[3][1])]
    return rows


@pytest.mark.parametrize("limit", [3, 64, 256])
def test_matches_plain_loops_at_every_block_size(spark, limit):
    rows = rows_for_test()
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in m.spelling_variants(df, limit).collect())
    assert got == sorted(m.brute_force(rows))
    assert any(r[1] for r in got) and any(r[4] > 20 for r in got)


def test_blocks_are_bounded_and_hold_every_pair_once(spark):
    many = ["same" + a + b + c + "tail" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    words = spark.createDataFrame([(w, 2) for w in many], "word string, n long")
    sizes = [r["count"] for r in m.blocks(words, 16).groupBy("key").count().collect()]
    assert max(sizes) <= 16 and sum(sizes) < 20 * len(many)
    found = {r.word: r.n_near for r in m.near_words(words, 16).collect()}
    assert found == dict.fromkeys(many, 21)  # seven other letters at each of three places


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    text = ("edoution thrélyes " * 50_000) + "x" * (1 << 20) + " edoution"
    got = m.text_words(3, text.encode())
    assert sum(got.values()) == 100_002


def test_chains_lead_to_one_root(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000}
    forms = spark.createDataFrame(list(zip(chain, list(chain)[1:], strict=False)), "word string, form string")
    assert {r.root for r in m.roots(forms).collect()} == {"abcdefghijk"}


def test_sql_says_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows_for_test(9, 60) if d is not None], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(m.oracle_sql()).fetchall()) == sorted(tuple(r) for r in m.spelling_variants(df).collect())


def test_empty_table(spark):
    assert m.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
