from quern.llm import quality as m


def test_every_trusted_document_counts(spark):
    labels = spark.range(20_500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert m._trusted(labels, m.TRUSTED).count() == 20_500
    assert m._trusted(labels, 7).count() == 7


def test_ids_are_never_broadcast_and_texts_travel_once_at_most(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "n"), (3, "again")], "doc_id long, text string")
    trusted = m._trusted(spark.range(0, 40, 2).selectExpr("id as doc_id", "1 as quality", "0 as toxic"), m.TRUSTED)
    flagged = m._flagged(rows, trusted)
    got = flagged.collect()
    assert sorted(r.text for r in got) == sorted([f"t{i}" for i in range(40)] + ["n", "again"])
    counted = {r.doc_id for r in spark.range(40).selectExpr("id as doc_id").where(m._fitted(m.F.col("doc_id"))).collect()}
    assert {r.text for r in got if r.trusted} == {f"t{i}" for i in range(0, 40, 2) if i in counted} and 0 < len(counted) < 40
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_weights_stand_in_no_plan(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 97}" for k in range(70))) for i in range(40)], "doc_id long, text string")
    model = m.fit(rows, spark.range(0, 40).selectExpr("id as doc_id", "1 as quality", "0 as toxic"))
    judged = m.judge(rows, model)
    assert len(judged._jdf.queryExecution().toString()) < m.BUCKETS  # as constants they took more than a megabyte
    assert "Subquery" in judged._jdf.queryExecution().executedPlan().toString()
    weights = model.weights.first()[0]
    assert len(weights) == m.BUCKETS and any(weights) and any(r.llr for r in judged.collect())
