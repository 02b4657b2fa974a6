import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import search, vector_index


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 12)) * 3
    rows = [(i, ["verse", "topic"][i % 2], (centres[i % 20] + rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, "verse", rows[0][2]) for i in range(700)]  # a hot cell
    rows += [(9000, "verse", None), (9001, "verse", []), (9002, "topic", [0.0] * 12)]
    return spark.createDataFrame(rows, "id int, entity_type string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(nodes, tmp_path_factory):
    return vector_index.build(nodes, f"{tmp_path_factory.mktemp('index')}/v", k=5)


@pytest.fixture(scope="module")
def queries(nodes):
    return nodes.where("id % 50 = 7 and id < 3000").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def found(df):
    return sorted((r.query_id, r.grp, round(r.distance, 6), r.id) for r in df.collect())


def exact(nodes, queries, k=5):
    usable = nodes.where("size(embedding) > 0")
    return search.nearest_by_group(usable, queries, k, "entity_type").withColumnRenamed("entity_type", "grp")


def test_all_cells_are_exact(nodes, index, queries):
    assert found(index.search(queries, 5, "all")) == found(exact(nodes, queries))
    assert found(index.search(queries, 5, "all", block=7)) == found(exact(nodes, queries))


def test_measured_probes_reach_the_recall_and_read_few_cells(spark, nodes, index, queries):
    assert len(index.centres) > 20 and index.about["probes"] < len(index.centres) / 2
    assert vector_index.recall_of(index.search(queries, 5), exact(nodes, queries)) >= 0.9
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = queries.limit(1)
        few, every = scanned_bytes(index.search(one, 5, 2)), scanned_bytes(index.search(one, 5, "all"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < few < every / 4


def scanned_bytes(df):
    """What the scan of an executed plan reads."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("filesSize").value()


def test_every_row_with_a_vector_is_stored_once(nodes, index):
    stored = index.rows().groupBy("id").count().collect()
    assert len(stored) == 3700 and {r["count"] for r in stored} == {1}


def test_rows_can_be_added(spark, nodes, tmp_path):
    first = vector_index.build(nodes.where("id < 1000"), f"{tmp_path}/v", cells=8)
    first.add(nodes.where("id >= 1000"))
    again = vector_index.VectorIndex(spark, f"{tmp_path}/v")
    asked = nodes.where("id = 2007").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert found(again.search(asked, 5, "all")) == found(exact(nodes, asked))


def test_odd_queries_and_an_empty_index(spark, index, nodes, tmp_path):
    asked = lambda v: spark.createDataFrame([(1, v)], "query_id int, vector array<double>")
    assert index.search(asked([0.0] * 12)).count() == 0
    with pytest.raises(ValueError):
        index.search(asked([1.0] * 5))
    with pytest.raises(ValueError):
        index.search(asked([1.0] * 12), 0)
    empty = vector_index.build(nodes.where("id = 9000"), f"{tmp_path}/e")
    assert empty.search(asked([1.0] * 12)).count() == 0
