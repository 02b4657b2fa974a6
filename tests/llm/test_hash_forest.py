import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hash_forest as m

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def exact(rows, k=20, every=20):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in good:
        if q % every == 0:
            found = sorted((-float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(found)]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA).repartition(parts)


def found(spark, rows, **more):
    out = m.nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in out)


def clustered(n, width=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width)) * 2
    return [(i, (centres[i % 12] + rng.standard_normal(width)).astype(np.float32).tolist()) for i in range(n)]


def test_small_tables_are_answered_exactly(spark):
    rows = clustered(150)
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(1040, rows[7][1]), (1060, rows[20][1])]  # ties go to smaller ids, a query isn't its own neighbour
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] + [1.0] * 15), (None, [1.0] * 16), (2100, [float("inf")] * 16)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [0.5, 0.5])]  # another length
    assert found(spark, rows, recall=1.0) == exact(rows)


def test_recall_and_scores_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(m, "CELL", 200)
    monkeypatch.setattr(m, "QUERIES", 50)
    rows = clustered(4000)
    got = found(spark, rows)
    assert m.recall_of(got, [(i, np.array(v)) for i, v in rows]) >= 0.9
    by_id = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    assert all(abs(s - by_id[q] @ by_id[i]) < 1e-6 and q != i for q, _, i, s in got)
    assert len(got) == 200 * 20 and [r[1] for r in got] == list(range(1, 21)) * 200


def test_equal_vectors_in_one_cell_are_one_point(spark, monkeypatch):
    monkeypatch.setattr(m, "CELL", 100)
    rows = clustered(900)
    rows[3] = (3, [10 * x for x in rows[3][1]])  # so its copies are what it is nearest to
    rows += [(10_000 + i, rows[3][1]) for i in range(600)]
    got = found(spark, rows)
    mine = [r for r in got if r[0] == 10_040]
    assert [r[2] for r in mine] == [3] + [10_000 + i for i in range(19)]
    forest = m.entries_of(table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(True).alias("queried")), True)
    assert forest.count() == 900 and forest.agg(F.max(F.size("ids"))).first()[0] == 21


def test_counts_of_an_ascent_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(m, "CELL", 100)
    rows = clustered(700)
    df = table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 20 == 0).alias("queried"))
    forest = m.entries_of(df, True)
    held = forest.collect()
    labels = np.array([r.labels for r in held])
    for bits in (0, 3):
        cells = m._in_trees(forest, "labels", bits).groupBy("tree", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.lit(2))
        got = {(bytes(r.entry), r.level): r.n for r in m.ascents(forest, bits, cells).collect()}
        want = {}
        for r in held:
            if r.asked is not None:
                depth = m.shared_bits(labels, np.array(r.asked)[None, :])
                want |= {(bytes(r.entry), x): n for x in range(m.BITS + 1) if (n := int((depth >= x).sum()))}
        assert got == want


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_empty_table_and_element_types(spark, kind):
    df = spark.createDataFrame([(0, [1.0, 0.1]), (20, [0.0, 1.0]), (3, [5.0, 5.0])], f"vec_id long, embedding {kind}")
    got = [tuple(r)[:3] for r in m.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert m.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
