import random

import corpus_pipeline as p
from quern.llm import decontaminate, jaccard_join, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_against_plain_loops(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(200)]
    items = [(k, " ".join(rng.choices(vocabulary, k=20))) for k in range(4)]
    rows = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(30, 140))
        if d % 9 == 0:
            words[5:5] = items[d % 4][1].split()
        if d % 7 == 0:
            words[3:3] = ["write", "to", f"a{d}@b.example.com"]
        if d % 13 == 0:
            words = [f"j{rng.randrange(50)}%%%" for _ in words]
        rows.append((d, " ".join(words)))
    rows += [(d + 100, rows[d][1] + " end") for d in range(0, 80, 5)]
    rows += [(300, None), (301, "")]
    labels = [(d, int(d % 13 != 0), 0) for d in range(80)]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    for name, stage in p.STAGES[:-1]:
        if name == "quality_rules":
            good = {r[0] for r in quality.brute_force(kept, labels) if r[-1]}
            kept = [r for r in kept if r[0] in good]
        elif name == "near_duplicates":
            kept = [r for r, c in zip(sorted(kept), jaccard_join.brute_force(kept)) if c[0] == c[1]]
        elif name == "benchmark_decontamination":
            leaks = {d for d, _ in decontaminate.brute_force(kept, items)}
            kept = [r for r in kept if r[0] not in leaks]
        else:
            kept = [(d, pii.redact(t, pii.base_spans(t))) for d, t in kept]
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == sorted(kept), name
        assert 0 < len(kept) < len(rows)
    packed = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in kept}
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


def test_rows_that_share_a_doc_id_or_have_none(spark, tmp_path):
    rng = random.Random(13)
    a, b, c, d, leak = (" ".join(rng.choices([f"word{i}" for i in range(200)], k=40)) for _ in range(5))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def kept(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)
        return sorted(((r.doc_id, r.text, r.source) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    rows = [(7, a, "s")] * 5 + [(None, b, "s")] * 3 + [(7, c, "s"), (3, c + " end", "s"), (None, c, "s"), (None, d, "s"), (None, None, "s"), (9, "", "s"), (9, "", "s")]
    want = [(7, a, "s"), (None, b, "s"), (3, c + " end", "s"), (None, d, "s"), (None, None, "s"), (9, "", "s"), (9, "", "s")]
    assert kept(p.near_duplicates, rows) == sorted(want, key=str)
    rows = [(1, a, "s"), (1, b + " " + leak, "s"), (None, leak, "s"), (None, c, "s"), (2, leak, "s"), (2, leak, "s"), (3, d, "s"), (3, d, "s"), (4, None, "s")]
    want = [(1, a, "s"), (None, c, "s"), (3, d, "s"), (3, d, "s"), (4, None, "s")]
    assert kept(p.benchmark_decontamination, rows) == sorted(want, key=str)


def test_clashing_columns_and_empty_tables_go_through_all_stages(spark, tmp_path):
    rng = random.Random(14)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(30)]
    texts[9], texts[12] = texts[3] + " end", texts[3]
    names = ["quern_number", "number", "row", "quern_row", "gone", "class_id", "kept", "quern_id", "entry", "item_id", "spans", "first", "quern_text", "n_words", "a.b"]
    schema = SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names)
    rows = [(d, t, "en", "s", len(t), *(f"{n}{d}" for n in names)) for d, t in enumerate(texts)]
    spark.createDataFrame([(1, " ".join(rng.choices(words, k=30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in p.STAGES[:-1]:
        docs, empty = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert docs.columns == empty.columns == [f.split()[0].strip("`") for f in schema.split(", ")], name
        assert empty.count() == 0
        for r in docs.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names), name
    assert {r.doc_id for r in docs.collect()} & {3, 9, 12} == {3}
    assert p.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0 < p.STAGES[-1][1](spark, docs, str(tmp_path)).count()
