import random
import time

from quern.llm import decontaminate as m

SCHEMA = "doc_id long, text string, item_id string"


def test_matches_full_alignment(spark):
    rng = random.Random(4)
    words = ["ab", "cde", "the", "of", "rain", "Stone", "lit", "é", "tion", "wh"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(14, 40)))) for k in range(12)] + [(90, "ab c"), (91, None), (92, ""), (93, "Stone of the rain"), (3, "twice " * 9)]
    rows = []
    for d in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        if d % 2:
            leak = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(leak) // 9)):
                k = rng.randrange(len(leak))
                leak[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz", "\n"])
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(leak).upper() + text[at:]
        rows.append((d, text))
    rows += [(100, None), (101, ""), (102, "z" * 50 + items[0][1].replace(" ", "\n") + "q" * 50)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = m.brute_force(rows, items)
    assert len(want) > 20
    for block in (m.BLOCK_CHARS, 150):
        got = m.benchmark_matches(docs, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if r.doc_id == 102 and r.item_id == 0]
    assert [(r.start, r.end, r.edits) for r in exact] == [(50, 50 + len(items[0][1]), 0)]
    assert m.benchmark_matches(docs.limit(0), bench).count() == 0
    assert m.benchmark_matches(docs, bench.limit(0)).count() == 0


def test_long_text_is_searched_in_full(spark, monkeypatch):
    item = "a passage that some benchmark holds, of about seventy characters in all"
    text = "filler words " * 2000
    rows = [(1, text[:13_333] + item + text + item + text), (None, item), (2, item), (2, item)]
    monkeypatch.setattr(m, "CHUNK", 1000)
    got = m.benchmark_matches(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.start) for r in got) == sorted([("1", 13_333), ("1", 13_333 + len(item) + len(text)), ("None", 0), ("2", 0), ("2", 0)])


def test_benchmark_rows_without_an_id_are_searched(spark):
    texts = ["a passage that some benchmark holds", "another one that has no number", "and a third one that has none"]
    docs = spark.createDataFrame([(k, f"filler {t} filler", "") for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(7, texts[0]), (None, texts[1]), (None, texts[2]), (None, None)], "item_id long, text string")
    for block in (m.BLOCK_CHARS, 40):
        got = m.benchmark_matches(docs, bench, block_chars=block).collect()
        assert sorted((r.doc_id, r.item_id, r.start, r.edits) for r in got) == [(0, 7, 7, 0), (1, None, 7, 0), (2, None, 7, 0)]


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    ix = m.Index([(1, b"-" * 2000), (2, b"abcabcabc" * 30), (3, b" " * 900 + b"end of it")])
    for text in ("-" * 131_072, "abc" * 40_000, " " * 120_000):
        tracemalloc.start()
        found = ix.candidates(m.normal(text.encode()))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found and peak < 300e6
    start = time.time()
    found = [x for x in ix.places(m.normal(b" " * 60_000)) if x[0] == 2]
    assert len(found) > 30 and {e for *_, e in found} == {7} and time.time() - start < 30
    assert {i for i, *_ in ix.places(m.normal(b"-" * 5000))} == {0}


def test_repetitive_texts_match_full_alignment(spark, monkeypatch):
    rng = random.Random(6)
    items = [(1, "-" * 40), (2, "ab" * 30), (3, "ab" * 15 + "cd" * 15), (4, "-" * 20 + "end of table" + "-" * 20), (5, "-" * 40)]
    rows = []
    for d in range(40):
        bits = rng.choices(["-" * rng.randint(5, 60), "ab" * rng.randint(3, 40), "cd" * rng.randint(3, 20), "end of table", "x"], k=rng.randint(1, 6))
        rows.append((d, "".join(bits)))
    monkeypatch.setattr(m, "SLICE", 50)
    docs = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)
    got = m.benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = m.brute_force(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20  # equal items 1 and 5 are both told


def test_nearly_equal_places_at_a_chunk_seam(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from it again"
    near = item.replace("lazy", "lazzy")
    monkeypatch.setattr(m, "CHUNK", 400)
    rows = [(k, "x" * (k * 7) + near + "y" * 30 + item + "z" * 500) for k in range(0, 60, 3)]
    got = m.benchmark_matches(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    for d, _ in rows:
        exact = [r for r in got if r.doc_id == d and r.edits == 0]
        assert [r.start for r in exact] == [d * 7 + len(near) + 30]
        assert [r.edits for r in got if r.doc_id == d and r.start < d * 7 + 5 and r.end > d * 7 + len(near) - 5] == [1]
