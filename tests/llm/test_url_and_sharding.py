import random
import zlib
from collections import Counter

import duckdb
import pandas as pd

from quern.llm import sharding, url_reputation


def test_urls_match_the_sql(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "example.com", "B.Example.net", "example.net", "x.org", "org", "shop.co.uk", "deep.shop.co.uk", "", "com", "other.io", "notexample.com"]
    paths = ["/en/7", "/en/8?q=://x/", "/de/8", "/de/80#t", "/es/", "/es", "?en/", "", "/EN/7", "/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no-scheme.com/en/", "ftp://://x", "http://a.org/es/\nx?y"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "host": "clash", "rate": 1})
    labels = pd.DataFrame([(i, int(rng.random() < (0.2 if i % 3 else 0.8)), int(rng.random() < 0.1)) for i in range(0, 380)] + [(5, 0, 0)], columns=["doc_id", "quality", "toxic"])
    con = duckdb.connect()
    con.register("pages", pages), con.register("labels", labels)
    want = Counter(con.execute(url_reputation.oracle_sql()).fetchall())
    p = spark.createDataFrame([tuple(r) for r in pages.itertuples(index=False)], "page_id long, url string, host string, rate long")
    got = Counter(tuple(r) for r in url_reputation.judge_urls(p, spark.createDataFrame(labels)).collect())
    assert got == want
    assert {v for *_, v, _ in got} == {"allow", "block"}
    rules = {(h, q): r for _, h, q, r, _, _ in got}
    assert rules["a.example.com", "/en/7"] == "example.com/en/7" and rules["notexample.com", "/en/7"] == "com/en/"
    assert rules["b.example.net", "/de/8"] == "example.net/de/8" and rules["", ""] is None


def test_hot_hosts_get_more_salts(spark, monkeypatch):
    monkeypatch.setattr(url_reputation, "SHARE", 10)
    urls = [f"http://hot.com/{i}" for i in range(95)] + [f"http://h{i % 20}.org/x" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://hot.com/x")] * 40, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 95), 0) for i in range(155) if not 50 <= i < 95], "doc_id long, quality int, toxic int")
    got = url_reputation.judge_urls(pages, labels).collect()
    assert len(got) == 195 and len({r.bad_rate for r in got if r.host == "hot.com"}) == 1
    assert Counter(r.verdict for r in got if r.host == "hot.com") == {"block": 135} and {r.verdict for r in got if r.host != "hot.com"} == {"allow"}


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.b/c"), (1, None), (1, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_reputation.judge_urls(pages, labels)
    assert sorted((r.host, r.verdict) for r in got.collect()) == [("", "allow"), ("", "allow"), ("a.b", "allow")]
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_shards_are_exact_and_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 60)
    monkeypatch.setattr(sharding, "CELL", 4)
    rows = [(i, "é" * (i % 7), "s") for i in range(1003)] + [(None, None, "s"), (None, None, "s"), (5, "same", "s"), (5, "same", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = sharding.digest(sharding.shard_rows(df)).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.shard_rows(df.limit(0)).count() == 0


def test_the_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 4000)
    rows = [(i, f"t{i}", "s") for i in range(6000)] + [(7, "same", "s")] * 2000
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3), 8).collect()
    for picked in (lambda r: r["size"] == 20 and r.doc_id == 7, lambda r: r.doc_id < 2000 and r.doc_id != 7, lambda r: r.doc_id % 3 == 0):
        per_shard = Counter(r.shard for r in got if picked(r))
        n = sum(per_shard.values())
        chi = sum((per_shard[k] - n / 8) ** 2 / (n / 8) for k in range(8))
        assert chi < 30  # 7 degrees of freedom; smaller than chance alone as sizes are fixed
        early = sum(picked(r) and r.slot < 500 for r in got)
        assert abs(early - n / 2) < 5 * (n / 4) ** 0.5


def test_draws_follow_the_distribution():
    rng = random.Random(1)
    draws = Counter(sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000))
    from math import comb

    for k in range(5):
        assert abs(draws[k] / 20_000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    big = [sharding.hypergeometric(rng, 10**9, 39 * 10**9, 10**7) for _ in range(50)]
    assert abs(sum(big) / 50 - 250_000) < 400
    matrix = sharding.communication_matrix([7, 0, 50, 3], [20, 20, 20], 4)
    assert [sum(r) for r in matrix] == [7, 0, 50, 3] and [sum(c) for c in zip(*matrix)] == [20, 20, 20]


def test_both_permutations_by_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 150)
    monkeypatch.setattr(sharding, "CELL", 5)
    written, whole = [], sharding.stash
    monkeypatch.setattr(sharding, "stash", lambda df, name: written.append(whole(df, name)) or written[-1])
    rows = [(d * 3 - 40, None if d % 50 == 7 else "é" * (d % 9) + "x") for d in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in sharding.shard_rows(df).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    texts = dict(rows)
    numbered = [(r.number, r.doc_id, texts[r.doc_id]) for r in written[0].collect()]
    assert got == sorted(sharding.brute_force(numbered))
