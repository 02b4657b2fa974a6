import random

from quern.llm import quality as m

SCHEMA = "doc_id long, text string, llr string, quern string"


def corpus():
    rng = random.Random(6)
    good = [f"g{i}" for i in range(60)] + ["of", "the", "é", "x y"]
    bad = [f"b{i}%%" for i in range(60)] + ["<|>", "#"]
    rows = []
    for d in range(120):
        words = rng.choices(bad if d % 5 == 0 else good, k=rng.randint(0, 150))
        if d % 7 == 0:
            words += words[:40] * rng.randint(0, 3)
        text = "".join(w + rng.choice([" ", " ", "\n", " \t", "\n\n"]) for w in words)
        rows.append((d * 5 - 40, text + "\n" + text[:30] if d % 3 == 0 else text))
    rows += [(9001, None), (9002, ""), (9003, "a b c " * 100), (9004, " \x0b one\x0c two\r three "), (9005, " wide  " * 60)]
    labels = [(d, int(i % 5 != 0), int(i % 11 == 0)) for i, (d, _) in enumerate(rows[:120]) if i % 2 == 0]
    return rows, [*labels, labels[3], (10**6, 1, 0)]


def test_matches_plain_loops(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, "l", "q") for d, t in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bound in (m.TRUSTED, 7):
        got = m.digest(m.judge(docs, m.fit(docs, marks, bound))).drop("llr").collect()
        assert sorted(tuple(r) for r in got) == sorted(m.brute_force(rows, labels, bound))
    assert 0 < sum(r.kept for r in got) < len(rows)


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, "", ""), (1, text, "", ""), (1, text, "", ""), (2, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = m.digest(m.judge(docs, m.fit(docs, none))).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert m.judge(docs.limit(0), m.fit(docs.limit(0), none)).count() == 0
