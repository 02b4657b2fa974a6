"""What a task holds doesn't grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import references
from quern.operators import mutations, search


def test_parser_keeps_little():
    made = references.parse_references.func
    made(pa.array(["Gen. 1:1"]))  # what the first call imports isn't counted
    tracemalloc.start()
    for k in range(30):
        out = made(pa.array([f"Gen. {k}:{i}; Ex. {i}:{k}, 5 (12); oops" for i in range(1000)] + [""]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 8_000_000  # 30,000 texts of several hundred bytes each
    assert out[7].as_py()["refs"][2] == {"volume": "ot", "slug": "ex", "chapter": 7, "verse": 5, "end_verse": 0}
    assert out[7].as_py()["errors"] == ["cannot parse chapter: oops"]
    assert out[1000].as_py() == {"refs": [], "errors": []}


@pytest.mark.parametrize("met", [7, 64, 1 << 20])
def test_nearest_in_slices(spark, monkeypatch, met):
    """However few distances a task holds at once, the neighbours are the same."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "id long, embedding array<float>").repartition(2)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(search, "MET", met)
    got = {(r.query_id, r.id) for r in search.nearest_many(rows, queries, 5).collect()}
    exact = {(q.query_id, r.id) for q in queries.collect() for r in search.nearest(rows, list(q.vector), 5).collect()}
    assert got == exact


def test_delete_sorts_no_edges(spark):
    nodes = spark.range(100).withColumn("x", F.lit(1))
    edges = spark.range(1000).select((F.col("id") % 100).alias("src_id"), F.col("id").alias("dst_id"))
    counts = mutations.delete(nodes, nodes.where("id < 3"), {"HAS": (edges, True, False)})[2]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = counts.select("*")
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [src_id" in plan
        assert tuple(counts.first()) == (3, 30)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_load_writes_what_its_tables_share(spark, tmp_path, monkeypatch):
    from quern.plans import corpus_queries, load, store

    made = []
    monkeypatch.setattr(load, "written", lambda rows, own=load.written: made.append(rows.columns) or own(rows))
    graph = corpus_queries.graph(spark, "/root/testdata/sf0.001", every=True)
    assert any("parsed" in c for c in made) and any("verse_id" in c for c in made) and any(c[0] == "id" for c in made)
    joined = graph.edges["TG_SEE_ALSO"]
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    kept = store.GraphStore(spark, str(tmp_path / "s"))
    kept.write({"a": spark.range(3), "b": lambda held: held["a"].where("id > 0")})
    assert kept.table("b").count() == 2
