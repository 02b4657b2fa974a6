"""Queries over the given tables that exercise each operator, with the same in SQL.

The tables stand in for the corpus: region, nation, customer and orders are volumes, books, chapters and verses; lineitem
holds edges with properties; embeddings are the vector labels; conversations are ordered verses and chat turns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.references import explode_references
from ..operators import embeddings, lookups, mutations, predicates, search, windows
from ..operators.paging import beyond, decode_cursor, encode_cursor, sort_columns
from ..sources import pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KINDS = ["verse_group", "chapter", "topical_guide", "bible_dict", "index", "jst_passage"]
KIND_SQL = "(['verse_group', 'chapter', 'topical_guide', 'bible_dict', 'index', 'jst_passage'])[label % 6 + 1]"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("label") % 6)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("entity_type"), "embedding")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries: vectors whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


#: Edge types that a derived edge may have: those that expansion follows from its type, and one that it doesn't.
RELATIONS = {k: [rel for rel, _ in search.EXPANSION[k]] + ["CONTAINS"] for k in KINDS}
RELATION_SQL = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN ({rels})[k % {len(rels)} + 1]" for k, rels in RELATIONS.items()) + " END"
REACHED_SQL = "CASE " + " ".join(f"WHEN src_type = '{k}' AND rel = '{rel}' THEN '{to}'" for k in KINDS for rel, to in search.EXPANSION[k]) + " END"


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Derived edges: seven of each vector, with the edge types of its kind in turn."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    rows = vectors(spark, d).join(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    relation = F.coalesce(*(F.when(F.col("entity_type") == k, F.get(F.array(*map(F.lit, rels)), F.col("k") % len(rels))) for k, rels in RELATIONS.items()))
    return rows.select(F.col("entity_type").alias("src_type"), F.col("id").alias("src_id"), relation.alias("rel"), ((F.col("id") * 7 + F.col("k")) % F.col("n")).alias("dst_id"))


NEAR = "CASE WHEN abs(distance) < 0.00005 THEN 0.0::DOUBLE ELSE round(distance, 4) END AS distance"
UNIT = "SELECT vec_id AS id, {k} AS entity_type, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings".format(k=KIND_SQL)
STAGE1_SQL = f"""u AS ({UNIT}), q AS (SELECT id AS query_id, e AS qe, nrm AS qn FROM u WHERE id % 100 = 0),
    dist AS (SELECT query_id, entity_type, id, 1 - list_inner_product(e, qe) / (nrm * qn) AS distance FROM u, q),
    s1 AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY query_id, entity_type ORDER BY distance, id) <= 10)"""
EDGES_SQL = f"""ed AS (SELECT entity_type AS src_type, id AS src_id, {RELATION_SQL} AS rel, (id * 7 + k) % (SELECT count(*) FROM embeddings) AS dst_id FROM u, range(1, 8) r(k)),
    ex AS (SELECT query_id, {REACHED_SQL} AS entity_type, dst_id AS id, distance + 0.05 AS distance, entity_type AS seed_type, id AS seed_id FROM s1 JOIN ed ON src_type = s1.entity_type AND src_id = s1.id
        WHERE rel <> 'CONTAINS' QUALIFY row_number() OVER (PARTITION BY query_id, seed_type, seed_id, rel ORDER BY dst_id) <= 5),
    s2 AS (SELECT * FROM ex x WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.query_id = x.query_id AND s1.entity_type = x.entity_type AND s1.id = x.id)
        QUALIFY row_number() OVER (PARTITION BY query_id, entity_type, id ORDER BY round(distance, 9), seed_type, seed_id) = 1),
    al AS (SELECT query_id, entity_type, id, distance, 1 AS stage FROM s1 UNION ALL SELECT query_id, entity_type, id, distance, 2 FROM s2)"""


def near():
    """The distance in four places; a tiny one is 0, whatever its sign."""
    return F.when(F.abs("distance") < 0.00005, 0.0).otherwise(F.round("distance", 4)).alias("distance")


def stage_one(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest_by_group(vectors(spark, d), query_vectors(spark, d), 10, "entity_type")


@query(f"WITH u AS ({UNIT}) SELECT query_id, id, {NEAR} FROM (SELECT q.id AS query_id, u.id, 1 - list_inner_product(u.e, q.e) / (u.nrm * q.nrm) AS distance FROM u, u AS q WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, u.id) <= 10)")
def knn_topk(spark, d):
    return search.nearest_many(vectors(spark, d), query_vectors(spark, d), 10).select("query_id", "id", near())


@query(f"WITH {STAGE1_SQL} SELECT query_id, entity_type, id, {NEAR} FROM s1")
def knn_multi_query(spark, d):
    return stage_one(spark, d).select("query_id", "entity_type", "id", near())


@query(f"WITH {STAGE1_SQL} SELECT query_id, entity_type, id, {NEAR} FROM s1")
def stage1_union(spark, d):
    nodes = {k: vectors(spark, d).where(F.col("entity_type") == k).select("id", F.lit("").alias("name"), F.lit("").alias("text"), search.metadata(chapterNumber=F.lit(1)).alias("metadata"), "embedding") for k in KINDS}
    return search.stage_one_many(nodes, query_vectors(spark, d)).select("query_id", "entity_type", "id", near())


@query(f"WITH {STAGE1_SQL}, {EDGES_SQL} SELECT query_id, seed_type, seed_id, entity_type, id, {NEAR} FROM ex")
def expand_one_hop(spark, d):
    return search.expand(stage_one(spark, d), graph_edges(spark, d)).select("query_id", "seed_type", "seed_id", "entity_type", "id", near())


@query(f"WITH {STAGE1_SQL}, {EDGES_SQL} SELECT query_id, entity_type, id, {NEAR} FROM s2")
def dedup_stage2(spark, d):
    s1 = stage_one(spark, d)
    return search.new_neighbours(s1, search.expand(s1, graph_edges(spark, d))).select("query_id", "entity_type", "id", near())


@query(f"""WITH {STAGE1_SQL}, {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(CASE WHEN entity_type = 'verse' THEN distance - 0.05 ELSE distance END, 9), stage, round(distance, 9), entity_type, id) AS position FROM al)
    SELECT query_id, entity_type, id, {NEAR}, position FROM r WHERE position <= 20""")
def contextual_search(spark, d):
    """The flagship: stage 1, expansion, deduplication, ranking, top 20."""
    found = search.contextual_search(stage_one(spark, d), graph_edges(spark, d))
    return found.select("query_id", "entity_type", "id", near(), F.col("position").cast("long").alias("position"))


@query("SELECT vec_id AS id, least(100, greatest(0, floor((1 - least(1.0, greatest(0.0, vec_id / 100.0 - 0.3))) * 100 + 0.5)))::INT AS percent FROM embeddings")
def relevance_percent(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), text.relevance_percent(F.col("vec_id") / 100.0 - 0.3).alias("percent"))


def label(spark: SparkSession, d: str) -> dict[str, predicates.Label]:
    """nation <- customer <- orders, with the relationships in both directions."""
    nation = predicates.Label(table(spark, d, "nation"), "n_nationkey")
    customer = predicates.Label(table(spark, d, "customer"), "c_custkey")
    orders = predicates.Label(table(spark, d, "orders"), "o_orderkey")
    nation.links["customers"] = predicates.Link(customer.nodes.select("c_nationkey", F.col("c_custkey").alias("far")), "c_nationkey", "far", customer)
    customer.links["orders"] = predicates.Link(orders.nodes.select("o_custkey", F.col("o_orderkey").alias("far")), "o_custkey", "far", orders)
    customer.links["nation"] = predicates.Link(customer.nodes.select(F.col("c_custkey").alias("near"), F.col("c_nationkey").alias("far")), "near", "far", nation)
    return {"nation": nation, "customer": customer, "orders": orders}


FILTERS = {
    "filter_eq": ({"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "filter_range": ({"c_acctbal_gte": 100.0, "c_acctbal_lt": 5000.0, "c_custkey_gt": 10, "c_custkey_lte": 1000}, "c_acctbal >= 100 AND c_acctbal < 5000 AND c_custkey > 10 AND c_custkey <= 1000"),
    "filter_contains": ({"c_name_contains": "77"}, "contains(c_name, '77')"),
    "filter_startswith": ({"c_mktsegment_startsWith": "A"}, "starts_with(c_mktsegment, 'A')"),
    "filter_endswith": ({"c_name_endsWith": "9"}, "ends_with(c_name, '9')"),
    "filter_regex": ({"c_name_regex": ".*[13]5[0-4]?"}, "regexp_full_match(c_name, '.*[13]5[0-4]?')"),
    "filter_in": ({"c_nationkey_in": [1, 3, 7]}, "c_nationkey IN (1, 3, 7)"),
    "filter_nin": ({"c_nationkey_nin": [1, 3, 7]}, "c_nationkey NOT IN (1, 3, 7)"),
    "filter_not": ({"c_mktsegment_not": "BUILDING"}, "c_mktsegment <> 'BUILDING'"),
    "filter_isnull": ({"c_name_isNull": False, "OR": [{"c_acctbal_isNull": True}, {"c_custkey_lt": 50}]}, "c_name IS NOT NULL AND (c_acctbal IS NULL OR c_custkey < 50)"),
    "filter_and_or_not": ({"OR": [{"AND": [{"c_acctbal_gt": 9000.0}, {"NOT": {"c_nationkey": 4}}]}, {"c_custkey_in": [5, 6]}]}, "(c_acctbal > 9000 AND NOT c_nationkey = 4) OR c_custkey IN (5, 6)"),
    "filter_rel_some": ({"orders_some": {"o_totalprice_gt": 400000.0}}, "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "filter_rel_single": ({"nation": {"n_name_contains": "A"}, "c_acctbal_lt": 0.0}, "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND contains(n_name, 'A')) AND c_acctbal < 0"),
    "filter_rel_in_or": (
        {"OR": [{"orders_some": {"o_orderstatus": "P"}}, {"NOT": {"nation": {"n_regionkey_lt": 4}}}]},
        "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 4)",
    ),
}
for _name, (_where, _sql) in FILTERS.items():
    QUERIES[_name] = lambda spark, d, w=_where: predicates.filtered(label(spark, d)["customer"], w).select("c_custkey", "c_name")
    ORACLE_SQL[_name] = f"SELECT c_custkey, c_name FROM customer WHERE {_sql}"


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000))")
def filter_rel_some_nested(spark, d):
    return predicates.filtered(label(spark, d)["nation"], {"customers_some": {"c_acctbal_gt": 0.0, "orders_some": {"o_totalprice_gt": 450000.0}}}).select("n_nationkey", "n_name")


SORT = [{"c_mktsegment": "DESC"}, {"c_acctbal": "ASC"}]
NUMBERED = "SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal ASC, c_custkey) AS n FROM customer"


@query(f"SELECT c_custkey, c_mktsegment, c_acctbal FROM ({NUMBERED}) WHERE n <= 25")
def sort_multi(spark, d):
    return table(spark, d, "customer").orderBy(*sort_columns(SORT, "c_custkey")).limit(25).select("c_custkey", "c_mktsegment", "c_acctbal")


@query(f"SELECT c_custkey, c_mktsegment, c_acctbal FROM ({NUMBERED}) WHERE n > 25 AND n <= 45")
def connection_page_after(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    order = sort_columns(SORT, "c_custkey")
    last = rows.orderBy(*order).limit(25).collect()[-1]
    cursor = encode_cursor([last["c_mktsegment"], last["c_acctbal"], last["c_custkey"]])
    keys = [x for s in SORT for x in s.items()] + [("c_custkey", "ASC")]
    return rows.where(beyond(keys, decode_cursor(cursor))).orderBy(*order).limit(20)


@query("SELECT count(*) AS total FROM customer WHERE c_acctbal > 0")
def total_count(spark, d):
    return predicates.filtered(label(spark, d)["customer"], {"c_acctbal_gt": 0.0}).agg(F.count("*").alias("total"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_inner_lookup(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("key"))
    return lookups.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, F.col("l_orderkey") == F.col("o_orderkey"), "key", "o_custkey")[0]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def join_anti_rejects(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return lookups.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, F.col("l_orderkey") == F.col("o_orderkey"), "o_orderkey", "x")[1]


VERSES_SQL = "SELECT conv_id, turn, 'v/t/c/' || conv_id || '/' || turn AS id FROM conversations"


def verses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.lit("t").alias("volume"), F.lit("c").alias("slug"), F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("number"), ids.verse_id(F.lit("t"), F.lit("c"), "conv_id", "turn").alias("id"))


@query(f"WITH v AS ({VERSES_SQL}) SELECT v.id, coalesce(w.id, '') AS end_id FROM v LEFT JOIN v w ON w.conv_id = v.conv_id AND w.turn = v.turn + 2 AND v.turn + 2 > 0")
def join_left_range_end(spark, d):
    rows = verses(spark, d).select("id", "volume", "slug", "chapter", (F.col("number") + 2).alias("end_verse"))
    return lookups.with_range_end(rows, verses(spark, d), "end_id").select("id", "end_id")


@query(f"WITH v AS ({VERSES_SQL}) SELECT v.id AS src_id, w.id AS dst_id FROM v JOIN v w ON w.conv_id = v.conv_id AND w.turn BETWEEN v.turn AND v.turn + 2")
def range_expand(spark, d):
    rows = verses(spark, d).select(F.col("id").alias("src_id"), "chapter", "number", (F.col("number") + 2).alias("last"))
    each = lookups.expand_range(rows, "number", "last", "each").withColumnRenamed("chapter", "c").drop("number")
    return lookups.lookup(each, verses(spark, d), (F.col("c") == F.col("chapter")) & (F.col("each") == F.col("number")), "id", "dst_id")[0].select("src_id", "dst_id")


@query("SELECT a.p_partkey AS src_id, b.p_partkey AS dst_id FROM part a JOIN part b ON b.p_name = a.p_name AND a.p_partkey <> b.p_partkey")
def join_self_see_also(spark, d):
    """All pairs of parts of one name, as many as asked for."""
    return lookups.pairs_of_equal(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT l_suppkey AS src_id, l_partkey AS dst_id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def pair_dedup_first(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), "l_orderkey", "l_linenumber")
    return lookups.first_of_pairs(rows, ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, l_orderkey FROM (SELECT p_partkey, l_orderkey, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM part JOIN lineitem ON l_partkey = p_partkey) WHERE n = 1")
def join_first_match(spark, d):
    items = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("place"))
    return lookups.first_match(table(spark, d, "part").select("p_partkey"), items, F.col("p_partkey") == F.col("l_partkey"), ["p_partkey"], "place", "l_orderkey", "l_orderkey")


@query("SELECT o_orderkey, 'v/' || r_name || '/' || n_name || '/' || c_custkey || '/' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hierarchy_path_ids(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("o_orderkey", ids.verse_id("r_name", "n_name", "c_custkey", "o_orderkey").alias("id"))


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    s AS (SELECT c.*, k * 3 AS start FROM c, range(0, (SELECT max(c) FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id))) r(k) WHERE k * 3 <= i AND i < k * 3 + 5 AND (k = 0 OR k * 3 - 3 + 5 < n))
    SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*)::INT AS n_rows, string_agg(coalesce(text, ''), ' ' ORDER BY i) AS text FROM s GROUP BY conv_id, start""")
def sliding_window_5_3(spark, d):
    return windows.sliding_groups(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("""SELECT conv_id, turn, n_sent, last_role FROM (SELECT conv_id, turn, role, (count(*) OVER w)::INT AS n_sent, first_value(role) OVER w AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def chat_history(spark, d):
    return windows.history(table(spark, d, "conversations")).select("conv_id", "turn", "n_sent", F.get("sent.role", F.lit(0)).alias("last_role"))


@query("""SELECT p_partkey AS id, CASE WHEN len(ph) > 0 THEN p_name || '. ' || array_to_string(ph[1:20], '; ') ELSE p_name END AS text FROM (
    SELECT p_partkey, any_value(p_name) AS p_name, coalesce(list('o' || l_orderkey ORDER BY l_orderkey, l_linenumber) FILTER (l_orderkey IS NOT NULL), []) AS ph FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)""")
def collect_phrases_top20(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("array<float>").alias("embedding"))
    phrases = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src_id"), F.struct("l_orderkey", "l_linenumber").alias("pos"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("phrase"))
    return embeddings.named_targets(nodes, phrases)


@query("SELECT doc_id, md5(CASE WHEN source = 'src3' THEN text ELSE source || ' ' || text END) AS digest FROM documents")
def case_compose_text(spark, d):
    made = text.summary_and_text(F.when(F.col("source") != "src3", F.col("source")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(made.cast("binary")).alias("digest"))


@query("SELECT d.doc_id AS id, md5(text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND coalesce(text, '') <> ''")
def embed_targets_missing(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("of"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["of"])
    docs = table(spark, d, "documents").join(done, F.col("doc_id") == F.col("of"), "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    return embeddings.targets(docs).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT o_orderkey, trim(k) AS kind FROM (SELECT o_orderkey, unnest(string_split(CASE o_orderkey % 3 WHEN 0 THEN 'tg, bd' WHEN 1 THEN 'cross-ref' ELSE ' or ,trn' END, ',')) AS k FROM orders)")
def category_explode(spark, d):
    kinds = F.when(F.col("o_orderkey") % 3 == 0, "tg, bd").when(F.col("o_orderkey") % 3 == 1, "cross-ref").otherwise(" or ,trn")
    return lookups.split_categories(table(spark, d, "orders").select("o_orderkey", kinds.alias("category"))).select("o_orderkey", "kind")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract(props, '$.k')::BIGINT || '}' AS again FROM events")
def json_notes(spark, d):
    parsed = F.from_json("props", "struct<k:long>")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS book FROM lineitem")
def carry_forward_prefix(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey")).alias("book"))
    return windows.carry_forward(rows, ["l_orderkey"], "place", "book").select("l_orderkey", "l_linenumber", "book")


@query("""SELECT o_orderkey, 'ot' AS volume, 'gen' AS slug, (o_orderkey % 50 + 1)::INT AS chapter, (o_orderkey % 31 + 1)::INT AS verse, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 31 + 4)::INT ELSE 0 END AS end_verse FROM orders
    UNION ALL SELECT o_orderkey, 'dc-testament', 'dc', (o_orderkey % 138 + 1)::INT, 1, 0 FROM orders UNION ALL SELECT o_orderkey, 'dc-testament', 'dc', 76, (o_orderkey % 9)::INT, 0 FROM orders""")
def ref_parse(spark, d):
    k = F.col("o_orderkey")
    span = F.when(k % 2 == 0, F.concat(F.lit("–"), (k % 31 + 4).cast("string"))).otherwise("")
    cited = F.concat(F.lit("Gen. "), (k % 50 + 1).cast("string"), F.lit(":"), (k % 31 + 1).cast("string"), span, F.lit(" (12-13); D&C "), (k % 138 + 1).cast("string"), F.lit("; 76:"), (k % 9).cast("string"), F.lit("."))
    return explode_references(table(spark, d, "orders").select("o_orderkey", cited.alias("cited")), F.col("cited"))[0].select("o_orderkey", "volume", "slug", "chapter", "verse", "end_verse")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\v]+', ' ', 'g'))) AS digest FROM documents")
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT o_orderkey, (o_orderkey % 40)::INT AS verse, substr('abc', (o_orderkey % 3 + 1)::INT, 1) AS marker FROM orders")
def footnote_key(spark, d):
    k = F.col("o_orderkey")
    key = text.footnote_key(F.concat((k % 40).cast("string"), F.substring(F.lit("abc"), (k % 3 + 1).cast("int"), F.lit(1))))
    return table(spark, d, "orders").select("o_orderkey", key["verse"].alias("verse"), key["marker"].alias("marker"))


@query("SELECT page_id, 'cache' || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '.html' AS path FROM pages WHERE regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]+)', 1) <> ''")
def url_cache_path(spark, d):
    moved = F.concat(F.lit("https://h.org/study"), F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1))
    return table(spark, d, "pages").where("parse_url(url, 'PATH') rlike '^/.'").select("page_id", text.cache_path(moved, "cache").alias("path"))


@query("""WITH x AS (SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)),
    y AS (SELECT page_id, h, min(i) AS i FROM x WHERE starts_with(h, '/') GROUP BY page_id, h)
    SELECT page_id, count(*)::INT AS n_links, string_agg('https://www.churchofjesuschrist.org' || h, ' ' ORDER BY i) AS links FROM y GROUP BY page_id""")
def page_links(spark, d):
    links = pages.index_links(F.col("html"), "/", skip=())
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n_links"), F.array_join(links, " ").alias("links"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def sha256_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("sha"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS digest FROM documents")
def truncate_300(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.shortened(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT p_partkey, replace(p_type, ' ', '_') AS code, contains(lower(p_name), lower('A')) AS has FROM part")
def text_helpers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("code"), text.contains_ci(F.col("p_name"), F.lit("A")).alias("has"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def mutation_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    return mutations.update(rows, F.col("c_nationkey") == 3, {"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit("x")}).drop("c_nationkey")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::BIGINT AS nodes_deleted, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))::BIGINT AS relationships_deleted")
def mutation_delete_counts(spark, d):
    nodes = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    return mutations.delete(nodes, nodes.where("o_orderstatus = 'P'"), {"HAS": (edges, True, False)})[2]


@query("SELECT coalesce(n.k, i.k) AS k, CASE WHEN n.k IS NULL THEN i.v WHEN i.k IS NULL THEN n.v ELSE n.v + i.v END AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) n FULL JOIN (SELECT c_custkey AS k, 1.0::DOUBLE AS v FROM customer WHERE c_custkey % 3 = 0) i ON n.k = i.k")
def mutation_merge(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return mutations.merge(rows.where("k % 2 = 0"), rows.where("k % 3 = 0").withColumn("v", F.lit(1.0)), ["k"], {"v": F.col("in.v")}, {"v": F.col("node.v") + F.col("in.v")})


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')")
def stub_nodes(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    known = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return mutations.connect_rows(edges.limit(0), edges, known, parts, "stub")[1]


@query("SELECT n_nationkey AS src_id, r_regionkey AS dst_id, 'all' AS note FROM nation, region")
def connect_sets(spark, d):
    nations, regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), table(spark, d, "region").select(F.col("r_regionkey").alias("id"))
    none = spark.createDataFrame([], "src_id int, dst_id int, note string")
    return mutations.connect(none, nations, regions, {"note": F.lit("all")})


@query("""SELECT c_custkey, y::BIGINT AS year, m AS month FROM (SELECT o_custkey AS c_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey), range(1900, 2100) t(y), (VALUES (4), (10)) u(m)
    WHERE y * 12 + m BETWEEN year(a) * 12 + month(a) AND year(b) * 12 + month(b)""")
def year_month_grid(spark, d):
    """The conferences between each customer's first and last order."""
    ends = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    grid = text.conference_grid((F.year("a"), F.month("a")), (F.year("b"), F.month("b")))
    return ends.select("c_custkey", F.explode(grid).alias("g")).select("c_custkey", F.col("g.year").cast("long").alias("year"), "g.month")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def rfc3339_format(spark, d):
    return table(spark, d, "events").select("event_id", F.replace(text.rfc3339(F.col("ts")), F.lit("+00:00"), F.lit("Z")).alias("stamp"))
