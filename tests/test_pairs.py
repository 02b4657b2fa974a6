"""Pairs of rows of one key: all of them, with little on disk."""

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import lookups
from quern.plans import catalogue


def sent(made) -> int:
    """Rows that a run writes to shuffles."""
    run = made._jdf.queryExecution()
    run.toRdd().count()
    todo, rows = [run.executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows


@pytest.mark.parametrize("blocks", [{}, {"LIST": 7, "TARGETS": 3, "SOURCES": 2, "MOST_COMMON": 1000}, {"TARGETS": 5, "MOST_COMMON": 1}])
def test_same_as_a_plain_join(spark, monkeypatch, blocks):
    """Null keys and values, repeated values, keys of one row, of two and of many."""
    for name, size in blocks.items():
        monkeypatch.setattr(lookups, name, size)
    rows = [(i, "many") for i in range(150)] + [(3, "many"), (None, "many"), (3, None), (4, None), (5, "one"), (6, "two"), (7, "two"), (8, "same"), (8, "same")] + [(i, f"some{i % 4}") for i in range(40)]
    rows = spark.createDataFrame(rows, "id long, name string").repartition(3)
    got = lookups.pairs_of_equal(rows, "name", "id")
    a, b = rows.select(F.col("id").alias("src_id"), "name"), rows.select(F.col("id").alias("dst_id"), "name")
    want = a.join(b, "name").where("src_id <> dst_id").select("src_id", "dst_id")
    assert got.columns == ["src_id", "dst_id"] and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert lookups.pairs_of_equal(rows.where("false"), "name", "id").count() == 0


@pytest.mark.parametrize("parts, names, most", [(6000, 3000, 5), (1000, 1, 1)])
def test_few_rows_are_sent(spark, tmp_path, parts, names, most):
    """Rows of rare names aren't repeated for shares, those of a common name travel in lists."""
    spark.range(parts).select(F.col("id").alias("p_partkey"), F.format_string("n%d", F.col("id") % names).alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    assert sent(catalogue.join_self_see_also(spark, str(tmp_path))) < most * parts


def test_pairs_take_little_disk(spark, tmp_path):
    """25 million pairs, in a quarter of a byte each."""
    spark.range(5000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    catalogue.join_self_see_also(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5000 * 4999
    assert sum(os.path.getsize(f"{tmp_path}/out/{f}") for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")) < 0.25 * 5000 * 4999
