import re

import pytest
from pyspark.sql import functions as F

from quern.sources import pages


@pytest.mark.parametrize("kind", sorted(pages.KINDS))
def test_readers_join_and_shuffle_nothing(spark, kind):
    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("<h1>x</h1>").alias("html"))
    made = pages.extract(rows, kind)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Exchange|Broadcast", plan)
    assert made.count() == 3


def test_nested_elements(spark):
    """What stands in two outer elements: a verse and its section's header in two sections, citations in a line within a line."""
    html = '<article><section><header><h2><strong>A</strong></h2></header><section><p class="verse"><span class="verse-number">2</span> in</p></section></section><div class="body-block"><p class="entry">x <b>y <a class="scripture-ref">Gen. 1:1</a></b> <sup>s</sup></p></div></article>'
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    got = {r.page_id: r.content for r in pages.extract(rows, "translation").collect()}
    assert [(s.heading, [(v.number, v.text) for v in s.verses]) for s in got[1].sections] == [("A", [(2, "in")]), ("", [(2, "in")])]
    assert got[2].sections == [] and got[2].title == ""
    line = {r.page_id: r.content for r in pages.extract(rows, "entry").collect()}[1].entries
    assert [tuple(e) for e in line] == [("x y s", "y Gen. 1:1 s", "")]


def test_parts_of_one_name_are_dealt_out(spark, tmp_path):
    """A name that all parts have isn't the work of one task."""
    from quern.plans import catalogue

    spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    made = catalogue.join_self_see_also(spark, str(tmp_path))
    assert made.distinct().count() == made.count() == 200 * 199
    assert made.select(F.spark_partition_id()).distinct().count() > 1
