import pytest
from pyspark.sql import functions as F

from quern.operators import nested, search
from quern.plans import store as s
from quern.plans.load import Graph, with_vectors
from quern.sources import schemas


def fresh(spark, tmp_path):
    return s.GraphStore(spark, f"{tmp_path}/store")


def small_graph(spark, n=50):
    vector = lambda i: [float(i % 7), 1.0, float(i % 3)]
    rows = {
        "Chapter": [(f"ch/{i}", i, f"s{i}", None, None) for i in range(n)],
        "Verse": [(f"v/{i}", i, f"r{i}", f"t{i}", None, None, None) for i in range(3 * n)],
        "VerseGroup": [(f"vg/{i}", f"g{i}", i, i, vector(i)) for i in range(n)],
    }
    nodes = {k: spark.createDataFrame(v, schemas.NODES[k].replace(" not null", "")) for k, v in rows.items()}
    edges = {r.type: spark.createDataFrame([], r.schema) for r in schemas.RELATIONSHIPS}
    edges["HAS_VERSE"] = spark.createDataFrame([(f"ch/{i // 3}", f"v/{i}") for i in range(3 * n)] * 2, "src_id string, dst_id string")
    edges["INCLUDES"] = spark.createDataFrame([(f"vg/{i}", f"v/{i}") for i in range(n)], "src_id string, dst_id string")
    return Graph(nodes, edges)


def test_a_reload_that_fails_midway_leaves_the_old_graph(spark, tmp_path):
    store = fresh(spark, tmp_path)
    assert store.current() == 0 and s.save_graph(store, small_graph(spark), 4) == 1
    broken = small_graph(spark, 80)
    broken.nodes["VerseGroup"] = broken.nodes["VerseGroup"].withColumn("text", F.when(F.col("id") == "vg/70", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        s.save_graph(store, broken, 4)
    assert store.current() == 1
    old = s.open_graph(store)
    assert old.nodes["Chapter"].count() == 50 and old.nodes["VerseGroup"].count() == 50 and set(old.edges) == {r.type for r in schemas.RELATIONSHIPS}
    assert s.save_graph(store, small_graph(spark, 60), 4) == 2
    assert s.open_graph(store).nodes["Chapter"].count() == 60 and s.open_graph(store, 1).nodes["Chapter"].count() == 50
    assert old.nodes["Chapter"].count() == 50  # a reader keeps its snapshot


def test_write_back_reads_what_it_replaces_and_keeps_the_other_tables(spark, tmp_path):
    store = fresh(spark, tmp_path)
    s.save_graph(store, small_graph(spark), 4)
    before = store.manifest()
    graph = s.open_graph(store)
    embedded = spark.createDataFrame([("ch/3", [1.0, 2.0, 3.0], None), ("ch/4", None, "failed")], "id string, embedding array<float>, error string")
    assert s.save_vectors(store, "Chapter", with_vectors(graph, "Chapter", embedded)) == 2
    after = store.manifest()
    assert {n for n in after if after[n] != before[n]} == {"nodes/Chapter"}
    rows = {r.id: r.summaryEmbedding for r in s.open_graph(store).nodes["Chapter"].collect()}
    assert rows["ch/3"] == [1.0, 2.0, 3.0] and rows["ch/4"] is None and len(rows) == 50
    with pytest.raises(ValueError):
        s.save_vectors(store, "Verse", graph.nodes["Verse"])


def test_of_two_writers_the_later_one_gets_a_conflict(spark, tmp_path, monkeypatch):
    one, two = fresh(spark, tmp_path), fresh(spark, tmp_path)
    table = spark.range(3)
    one.write({"t": table})
    monkeypatch.setattr(two, "current", lambda: 0)
    with pytest.raises(s.Conflict):
        two.write({"t": spark.range(9)})
    assert one.table("t").count() == 3 and one.current() == 1


def test_expansion_doesnt_shuffle_the_edges(spark, tmp_path):
    store = fresh(spark, tmp_path)
    s.save_graph(store, small_graph(spark), 4)
    edges = store.table(s.SEARCH_EDGES)
    assert edges.count() == 150 + 50  # each once
    seeds = spark.createDataFrame([(0, "chapter", "ch/1", 0.1), (0, "verse_group", "vg/2", 0.2)], "query_id int, entity_type string, id string, distance double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.expand(seeds, edges)
        assert sorted((r.entity_type, r.id) for r in found.collect()) == [("verse", "v/2"), ("verse", "v/3"), ("verse", "v/4"), ("verse", "v/5")]
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(k for k, x in enumerate(plan.split("\n")) if "SortMergeJoin" in x)
    below = plan.split("\n")[join:]
    scan = next(k for k, x in enumerate(below) if "Scan parquet" in x or "FileScan parquet" in x)
    assert "Bucketed: true" in below[scan] and not any("Exchange" in x for x in below[:scan])
    again = s.GraphStore(spark.newSession(), store.root).table(s.SEARCH_EDGES)  # another session makes its own entry in the catalogue
    assert again.count() == 200


def test_a_mutation_is_a_version(spark, tmp_path):
    store = fresh(spark, tmp_path)
    s.save_graph(store, small_graph(spark), 4)
    model = s.open_graph(store).model()
    after = nested.applied(model, nested.plan_update(model, "Chapter", {"id": "ch/1"}, {"summary": "new", "verses": {"delete": [{"where": {"number": 4}}]}}))
    assert s.save_model(store, model, after) == 2
    graph = s.open_graph(store)
    assert graph.nodes["Verse"].count() == 149 and graph.nodes["Chapter"].where("summary = 'new'").count() == 1
    assert store.table(s.SEARCH_EDGES).where("dst_id = 'v/4'").count() == 0
    assert store.table(s.SEARCH_EDGES, 1).where("dst_id = 'v/4'").count() == 2


def test_vacuum_keeps_the_last_versions(spark, tmp_path):
    store = fresh(spark, tmp_path)
    for k in range(4):
        store.write({"t": spark.range(k), **({"nodes/N": spark.range(9)} if k == 0 else {})})
    gone = store.vacuum(2)
    assert len(gone) == 2 and store.versions() == [3, 4] and store.table("t").count() == 3 and store.table("t", 3).count() == 2 and store.table("nodes/N").count() == 9
    store.write({"t": None})
    with pytest.raises(KeyError):
        store.table("t")


def test_ids_are_looked_up_through_bloom_filters(spark, tmp_path):
    store = fresh(spark, tmp_path)
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    sizes = []
    for bloom in ((), ("id",)):
        store.write({"t": rows}, {"t": s.Layout(bloom=bloom)})
        at = f"{store.root}/{store.manifest()['t']['folder']}"
        sizes.append(sum(store.files.fs.getFileStatus(store.files.path(f"{at}/{n}")).getLen() for n in store.files.names(at)))
    assert sizes[1] > sizes[0] + 20_000  # the filters are there
    assert store.manifest()["t"]["bloom"] == ["id"] and store.table("t").where(F.col("id") == F.sha2(F.lit("77"), 256)).count() == 1
