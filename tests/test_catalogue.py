import os

import duckdb
import pytest

from quern.plans import catalogue, corpus_queries, graph_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


QUERIES = catalogue.QUERIES | corpus_queries.QUERIES | graph_queries.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | corpus_queries.ORACLE_SQL | graph_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    answer = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = plain(tuple(r[names.index(c)] for c in columns) for r in answer.fetchall())
    assert plain(tuple(r) for r in df.select(*columns).collect()) == want


def test_filters_reach_the_scan(spark):
    from quern.operators import predicates

    plan = predicates.filtered(catalogue.label(spark, DATA)["customer"], {"c_acctbal_gt": 9000.0}).select("c_custkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,9000.0)]" in plan and "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan
