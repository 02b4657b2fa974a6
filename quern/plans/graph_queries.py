"""Queries over connections and nested mutations, with the same in SQL.

The graph: regions have nations, nations customers, customers orders; parts have suppliers by line items, which are edges with properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections
from ..functions.accessor import accessor, named_values, shown_values
from ..operators import embeddings, nested, search, selections, vector_index
from ..operators.model import Field, Model
from ..sources import corpus, files
from ..sources.shared import fresh_folder
from ..streaming import keyed
from . import catalogue, corpus_queries, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


FIELDS = [
    Field("Region", "nations", "IN_REGION", "Nation"),
    Field("Nation", "customers", "IN_NATION", "Customer"),
    Field("Customer", "nation", "IN_NATION", "Nation", inward=True),
    Field("Customer", "orders", "PLACED", "Order", properties=("priority",)),
    Field("Part", "suppliers", "SUPPLIED", "Supplier", properties=("orderkey", "line", "quantity")),
]


def model(spark: SparkSession, d: str) -> Model:
    table = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("region", "nation", "customer", "orders", "part", "supplier", "lineitem")}
    shown = lambda n, **columns: table[n].select(*(F.col(c).cast("long" if k.endswith("id") else dict(table[n].dtypes)[c]).alias(k) for k, c in columns.items()))
    return Model(
        {
            "Region": shown("region", id="r_regionkey", name="r_name"),
            "Nation": shown("nation", id="n_nationkey", name="n_name"),
            "Customer": shown("customer", id="c_custkey", balance="c_acctbal", segment="c_mktsegment"),
            "Order": shown("orders", id="o_orderkey", status="o_orderstatus", price="o_totalprice"),
            "Part": shown("part", id="p_partkey", name="p_name"),
            "Supplier": shown("supplier", id="s_suppkey", balance="s_acctbal"),
        },
        {
            "IN_REGION": shown("nation", src_id="n_regionkey", dst_id="n_nationkey"),
            "IN_NATION": shown("customer", src_id="c_nationkey", dst_id="c_custkey"),
            "PLACED": shown("orders", src_id="o_custkey", dst_id="o_orderkey", priority="o_orderpriority"),
            "SUPPLIED": shown("lineitem", src_id="l_partkey", dst_id="l_suppkey", orderkey="l_orderkey", line="l_linenumber", quantity="l_quantity").distinct(),
        },
        FIELDS,
    )


def numbered_edges(found: DataFrame, *kept: str) -> DataFrame:
    """A row for each edge of a connection, numbered from 1."""
    return found.select(*kept, "connection", F.posexplode("connection.edges").alias("at", "edge"))


PAGED = """r AS (SELECT c_nationkey AS parent, c_custkey AS id, c_acctbal AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS total
    FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@query(f"""WITH {PAGED} SELECT parent, ((n - 1) // 3 + 1)::INT AS page, ((n - 1) % 3 + 1)::INT AS nth, id, balance, total > ((n - 1) // 3 + 1) * 3 AS more, n > 3 AS earlier, total FROM r WHERE n <= 6""")
def connection_two_pages(spark, d):
    """The three richest customers of each nation, and the three after them by each nation's own cursor."""
    graph = model(spark, d)
    label, parents = graph.label("Nation"), graph.nodes["Nation"].select(F.col("id").alias("parent"))
    wanted = {"first": 3, "where": {"segment_not": "BUILDING"}, "sort": [{"balance": "DESC"}], "totalCount": True}
    one = selections.connection(label, "customers", selections.parsed(wanted), parents)
    ends = one.select(F.col("parent").alias("of"), F.col("connection.pageInfo.endCursor").alias("mark"))
    two = selections.connection(label, "customers", selections.parsed(wanted | {"after": ends}), parents)
    both = one.withColumn("page", F.lit(1)).unionByName(two.withColumn("page", F.lit(2)))
    return numbered_edges(both, "parent", "page").select(
        "parent", "page", (F.col("at") + 1).alias("nth"), "edge.node.id", "edge.node.balance", F.col("connection.pageInfo.hasNextPage").alias("more"),
        F.col("connection.pageInfo.hasPreviousPage").alias("earlier"), F.col("connection.totalCount").alias("total"),
    )


@query("""SELECT parent, (n - 1)::INT AS at, id, orderkey, line, quantity, total FROM (SELECT l_partkey AS parent, s_suppkey AS id, l_orderkey AS orderkey, l_linenumber AS line, l_quantity AS quantity,
    row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal, s_suppkey, l_orderkey, l_linenumber, l_quantity) AS n, count(*) OVER (PARTITION BY l_partkey) AS total
    FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_acctbal > 0) WHERE n <= 4""")
def connection_edge_properties(spark, d):
    """Suppliers of each part with the properties of the edge; parallel edges stand side by side."""
    graph = model(spark, d)
    page = selections.parsed({"first": 4, "where": {"balance_gt": 0.0}, "sort": [{"balance": "ASC"}], "totalCount": True})
    found = selections.connection(graph.label("Part"), "suppliers", page, graph.nodes["Part"].select(F.col("id").alias("parent")))
    return numbered_edges(found, "parent").select("parent", "at", "edge.node.id", "edge.properties.*", F.col("connection.totalCount").alias("total"))


@query("""WITH a AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC, n_nationkey) <= 2),
    b AS (SELECT c_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS i FROM customer WHERE c_acctbal > 100 QUALIFY i <= 3),
    e AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS j FROM orders WHERE o_orderstatus <> 'P' QUALIFY j <= 2)
    SELECT r AS region, n AS nation, c AS customer, o AS id, priority FROM a JOIN b USING (n) LEFT JOIN e USING (c)""")
def connection_nested(spark, d):
    """Three levels in one selection: nations of regions, customers of these, orders of these (none for some)."""
    orders = {"first": 2, "where": {"status_not": "P"}, "sort": [{"price": "DESC"}], "fields": ["id"]}
    customers = {"first": 3, "where": {"balance_gt": 100.0}, "sort": [{"balance": "ASC"}], "fields": ["id"], "ordersConnection": orders}
    found = selections.selected(model(spark, d).label("Region"), {"fields": ["id"], "nationsConnection": {"first": 2, "sort": [{"name": "DESC"}], "fields": ["id", "name"], "customersConnection": customers}})
    nations = found.select(F.col("id").alias("region"), F.explode("nationsConnection.edges").alias("e")).select("region", F.col("e.node.id").alias("nation"), F.explode("e.node.customersConnection.edges").alias("c"))
    rows = nations.select("region", "nation", F.col("c.node.id").alias("customer"), F.explode_outer("c.node.ordersConnection.edges").alias("o"))
    return rows.select("region", "nation", "customer", "o.node.id", "o.properties.priority")


@query(f"""WITH {corpus_queries.V}, r AS (SELECT c, id, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, id) AS i, count(*) OVER (PARTITION BY c) AS total FROM v)
    SELECT 'ch/ot/gen/' || r.c AS chapter, r.id, r.n AS number, total > 3 AS more, CASE WHEN r.n = 1 THEN w.id END AS cited, CASE WHEN r.n = 1 AND w.id IS NOT NULL THEN '1a' END AS marker
    FROM r LEFT JOIN v w ON w.c = r.c AND w.n = 2 WHERE i <= 3""")
def graph_verses_connection(spark, d):
    """Verses of the chapters of a loaded graph, with what each cites and the note's marker."""
    cited = {"first": 5, "fields": ["id"], "properties": ["footnoteMarker"]}
    verses = {"first": 3, "sort": [{"number": "DESC"}], "fields": ["id", "number"], "crossRefsOutConnection": cited}
    found = selections.selected(corpus_queries.graph(spark, d).model().label("Chapter"), {"fields": ["id"], "versesConnection": verses})
    rows = found.select(F.col("id").alias("chapter"), F.col("versesConnection.pageInfo.hasNextPage").alias("more"), F.explode("versesConnection.edges").alias("e"))
    rows = rows.select("chapter", "more", "e.node.id", "e.node.number", F.explode_outer("e.node.crossRefsOutConnection.edges").alias("x"))
    return rows.select("chapter", "id", "number", "more", F.col("x.node.id").alias("cited"), F.col("x.properties.footnoteMarker").alias("marker"))


# --- nested mutations -----------------------------------------------------------------------------------------------------------------------

#: Keys of what is created, beyond those in the tables.
NEW = 1_000_000_000


def new_customers(spark: SparkSession, d: str) -> DataFrame:
    """A customer for each supplier: connected to its nation (and one that isn't there), with an order created and one connected for each of its first items."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").select(F.col("l_suppkey").alias("of"), F.col("l_orderkey").cast("long").alias("o"), "l_returnflag")
    edge = F.struct(F.col("l_returnflag").alias("priority"))
    made = F.struct(F.struct((F.col("o") + NEW).alias("id"), F.lit("N").alias("status")).alias("node"), edge.alias("edge"))
    known = F.struct(F.struct(F.col("o").alias("id")).alias("where"), edge.alias("edge"))
    held = items.groupBy("of").agg(F.struct(F.collect_list(made).alias("create"), F.collect_list(known).alias("connect")).alias("orders"))
    nations = F.array(F.struct(F.struct(F.col("s_nationkey").cast("long").alias("id")).alias("where")), F.struct(F.struct((F.col("s_suppkey") % 3 + NEW).cast("long").alias("id")).alias("where")))
    rows = spark.read.parquet(f"{d}/supplier.parquet").join(held, F.col("s_suppkey") == F.col("of"), "left")
    return rows.select((F.col("s_suppkey") + NEW).cast("long").alias("id"), F.col("s_acctbal").alias("balance"), F.struct(nations.alias("connect")).alias("nation"), "orders")


def planned_create(spark: SparkSession, d: str) -> tuple[Model, list[nested.Delta]]:
    graph = model(spark, d)
    return graph, nested.plan_create(graph, "Customer", new_customers(spark, d))


ITEMS = f"i AS (SELECT l_suppkey + {NEW} AS c, l_orderkey::BIGINT AS o, l_returnflag AS p FROM lineitem WHERE l_linenumber = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier))"
CREATED_EDGES = f"""{ITEMS}, e AS (SELECT 'IN_NATION' AS kind, s_nationkey::BIGINT AS src_id, s_suppkey + {NEW} AS dst_id, NULL::VARCHAR AS priority FROM supplier UNION SELECT 'IN_NATION', s_suppkey % 3 + {NEW}, s_suppkey + {NEW}, NULL FROM supplier
    UNION SELECT 'PLACED', c, o + {NEW}, p FROM i UNION SELECT 'PLACED', c, o, p FROM i)"""


@query(f"WITH {CREATED_EDGES} SELECT kind, src_id, dst_id, priority FROM e")
def mutation_nested_create(spark, d):
    """The edges that a nested create makes, of whole tables."""
    _, steps = planned_create(spark, d)
    made = [s.rows.select(F.lit(s.name).alias("kind"), "src_id", "dst_id", (F.col("priority") if "priority" in s.rows.columns else F.lit(None).cast("string")).alias("priority")) for s in steps if s.kind == "edge"]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


@query(f"""WITH {CREATED_EDGES} SELECT ((SELECT count(*) FROM supplier) + (SELECT count(DISTINCT o) FROM i) + (SELECT count(DISTINCT s_suppkey % 3) FROM supplier) + (SELECT count(DISTINCT o) FROM i WHERE o NOT IN (SELECT o_orderkey FROM orders)))::BIGINT AS nodes_created,
    0::BIGINT AS nodes_updated, 0::BIGINT AS nodes_deleted, count(*)::BIGINT AS relationships_created, 0::BIGINT AS relationships_updated, 0::BIGINT AS relationships_deleted FROM e""")
def mutation_nested_create_counts(spark, d):
    """Stubs for missing nations and orders are created nodes too."""
    return nested.counts(*planned_create(spark, d))


def planned_update(spark: SparkSession, d: str) -> tuple[Model, list[nested.Delta]]:
    """Of nations whose name has an A: renamed; customers of one segment changed together with their orders, poor ones disconnected, the richest
    deleted, one created, and those of nation 0 connected."""
    graph = model(spark, d)
    orders = {"update": {"where": {"status": "O"}, "node": {"price": F.col("price") * 2}, "edge": {"priority": "changed"}}, "disconnect": [{"where": {"status": "P"}}]}
    customers = {
        "update": {"where": {"segment": "BUILDING"}, "node": {"segment": "changed", "orders": orders}},
        "disconnect": [{"where": {"balance_lt": 0.0}}],
        "delete": [{"where": {"balance_gt": 9000.0}}],
        "create": [{"node": {"id": NEW, "segment": "created"}}],
        "connect": [{"where": {"nation": {"id": 0}}}],
    }
    return graph, nested.plan_update(graph, "Nation", {"name_contains": "A"}, {"name": F.lower("name"), "customers": customers})


UPDATED = f"""m AS (SELECT n_nationkey AS n FROM nation WHERE contains(n_name, 'A')), l AS (SELECT c_custkey AS c, c_nationkey AS n, c_acctbal AS b, c_mktsegment AS s FROM customer JOIN m ON c_nationkey = n),
    x AS (SELECT c FROM l WHERE b > 9000), u AS (SELECT c FROM l WHERE s = 'BUILDING'), o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders),
    p AS (SELECT n, c_custkey AS c FROM m, customer WHERE c_nationkey = 0 AND NOT (n = 0)),
    ea AS (SELECT 'IN_NATION' AS kind, c_nationkey::BIGINT AS src_id, c_custkey::BIGINT AS dst_id, NULL::VARCHAR AS priority FROM customer WHERE c_custkey NOT IN (SELECT c FROM l WHERE b < 0)
        UNION ALL SELECT 'IN_NATION', n, c, NULL FROM p UNION ALL SELECT 'IN_NATION', n, {NEW}, NULL FROM m),
    eb AS (SELECT 'PLACED' AS kind, c AS src_id, o AS dst_id, CASE WHEN s = 'O' AND c IN (SELECT c FROM u) THEN 'changed' ELSE p END AS priority FROM o WHERE NOT (s = 'P' AND c IN (SELECT c FROM u))),
    e AS (SELECT * FROM ea WHERE dst_id NOT IN (SELECT c FROM x) UNION ALL SELECT * FROM eb WHERE src_id NOT IN (SELECT c FROM x))"""


@query(f"WITH {UPDATED} SELECT kind, src_id::BIGINT AS src_id, dst_id::BIGINT AS dst_id, priority FROM e")
def mutation_nested_update_edges(spark, d):
    """All edges of nations and customers after the update."""
    after = nested.applied(*planned_update(spark, d)).edges
    rows = after["IN_NATION"].select(F.lit("IN_NATION").alias("kind"), "*", F.lit(None).cast("string").alias("priority"))
    return rows.unionByName(after["PLACED"].select(F.lit("PLACED").alias("kind"), "*"))


@query(f"""WITH {UPDATED} SELECT 'Customer' AS label, c_custkey::BIGINT AS id, CASE WHEN c_custkey IN (SELECT c FROM u) THEN 'changed' ELSE c_mktsegment END AS word, c_acctbal AS number FROM customer WHERE c_custkey NOT IN (SELECT c FROM x)
    UNION ALL SELECT 'Customer', {NEW}, 'created', NULL UNION ALL SELECT 'Nation', n_nationkey, CASE WHEN contains(n_name, 'A') THEN lower(n_name) ELSE n_name END, NULL FROM nation
    UNION ALL SELECT 'Order', o, s, CASE WHEN s = 'O' AND c IN (SELECT c FROM u) THEN t * 2 ELSE t END FROM o""")
def mutation_nested_update_nodes(spark, d):
    """All nodes after the update."""
    after = nested.applied(*planned_update(spark, d)).nodes
    none = F.lit(None).cast("double").alias("number")
    rows = after["Customer"].select(F.lit("Customer").alias("label"), "id", F.col("segment").alias("word"), F.col("balance").alias("number"))
    return rows.unionByName(after["Nation"].select(F.lit("Nation").alias("label"), "id", F.col("name").alias("word"), none)).unionByName(after["Order"].select(F.lit("Order").alias("label"), "id", F.col("status").alias("word"), F.col("price").alias("number")))


@query(f"""WITH {UPDATED} SELECT 1::BIGINT AS nodes_created, ((SELECT count(*) FROM m) + (SELECT count(*) FROM u) + (SELECT count(*) FROM o WHERE s = 'O' AND c IN (SELECT c FROM u)))::BIGINT AS nodes_updated, (SELECT count(*) FROM x)::BIGINT AS nodes_deleted,
    ((SELECT count(*) FROM m) + (SELECT count(*) FROM p))::BIGINT AS relationships_created, (SELECT count(*) FROM o WHERE s = 'O' AND c IN (SELECT c FROM u))::BIGINT AS relationships_updated,
    ((SELECT count(*) FROM l WHERE b < 0 OR b > 9000) + (SELECT count(*) FROM o WHERE c IN (SELECT c FROM x) OR (s = 'P' AND c IN (SELECT c FROM u))))::BIGINT AS relationships_deleted""")
def mutation_nested_update_counts(spark, d):
    return nested.counts(*planned_update(spark, d))


# --- search ---------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {catalogue.STAGE1_SQL} SELECT query_id, entity_type AS grp, id, {catalogue.NEAR} FROM s1")
def vector_index_exact(spark, d):
    """A stored index, searched in all its cells."""
    index = vector_index.build(catalogue.vectors(spark, d), fresh_folder(spark, "index"))
    return index.search(catalogue.query_vectors(spark, d), 10, "all").select("query_id", "grp", "id", catalogue.near())


@query("SELECT true AS reached")
def vector_index_recall(spark, d):
    """Whether the probes that were measured find nine tenths of what an exact search finds, over all stated queries."""
    index = vector_index.build(catalogue.vectors(spark, d), fresh_folder(spark, "index"))
    queries = catalogue.query_vectors(spark, d)
    exact = search.nearest_by_group(catalogue.vectors(spark, d), queries, 10, "entity_type").withColumnRenamed("entity_type", "grp")
    found = index.search(queries, 10).select("query_id", "grp", "id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "grp", "id"], "left").agg((F.count("found") >= 0.9 * F.count("*")).alias("reached"))


#: Label and id of the search graph's nodes by kind; verses have no vector.
SHOWN = {"verse_group": ("VerseGroup", "vg/a/b/{0}/1-5"), "chapter": ("Chapter", "ch/a/b/{0}"), "topical_guide": ("TopicalGuideEntry", "tg/{0}"), "bible_dict": ("BibleDictEntry", "bd/{0}"), "index": ("IndexEntry", "idx/{0}"), "jst_passage": ("JSTPassage", "jst/{0}")}
ASKED = "what is it"


class FixedEmbedder:
    """The vector of a text: its j-th component comes from j and the text's length."""

    def embed_batch(self, texts):
        return [[float((len(t) * 7 + j * 5) % 11 - 5) for j in range(64)] for t in texts]


def search_nodes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    v = catalogue.vectors(spark, d)
    key = lambda shape: corpus_queries.said(*(x for x in (shape.split("{0}")[0], F.col("id"), shape.split("{0}")[1]) if not isinstance(x, str) or x))
    own = lambda kind: v.where(F.col("entity_type") == kind)
    words, none, vector = corpus_queries.said("t", F.col("id")).alias("text"), F.lit(None).cast("string"), F.col("embedding")
    columns = {
        "verse_group": [words, F.lit(1).alias("startVerseNumber"), F.lit(5).alias("endVerseNumber"), vector],
        "chapter": [F.col("id").cast("int").alias("number"), corpus_queries.said("s", F.col("id")).alias("summary"), vector.alias("summaryEmbedding"), none.alias("url")],
        "topical_guide": [corpus_queries.said("n", F.col("id")).alias("name"), vector], "bible_dict": [corpus_queries.said("n", F.col("id")).alias("name"), words, vector],
        "index": [corpus_queries.said("n", F.col("id")).alias("name"), vector], "jst_passage": [F.lit("B").alias("book"), F.lit("1").alias("chapter"), F.lit("1-2").alias("comprises"), none.alias("compareRef"), none.alias("summary"), words, vector],
    }
    out = {SHOWN[k][0]: own(k).select(key(SHOWN[k][1]).alias("id"), *c) for k, c in columns.items()}
    out["Verse"] = v.select(corpus_queries.said("v/", F.col("id")).alias("id"), F.col("id").cast("int").alias("number"), corpus_queries.said("r", F.col("id")).alias("reference"), words)
    return out


def ids_of(kind, number) -> F.Column:
    """The id of a node from its kind and number."""
    shapes = {k: shape.split("{0}") for k, (_, shape) in SHOWN.items()} | {"verse": ["v/", ""]}
    part = lambda i: F.create_map(*(F.lit(x) for k, ends in shapes.items() for x in (k, ends[i])))[kind]
    return F.concat(part(0), number.cast("string"), part(1))


def _sql_id(kind: str, number: str) -> str:
    shapes = {k: shape for k, (_, shape) in SHOWN.items()} | {"verse": "v/{0}"}
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN replace('{shape}', '{{0}}', {number}::VARCHAR)" for k, shape in shapes.items()) + " END"


ONE_STAGE1 = f"""u AS ({catalogue.UNIT}), q AS (SELECT list((({len(ASKED)} * 7 + j * 5) % 11 - 5)::DOUBLE ORDER BY j) AS qe FROM range(64) t(j)),
    dist AS (SELECT 0 AS query_id, entity_type, id, 1 - list_inner_product(e, qe) / (nrm * sqrt(list_inner_product(qe, qe))) AS distance FROM u, q),
    s1 AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY distance, {_sql_id('entity_type', 'id')}) <= 10)"""
ONE_EDGES = catalogue.EDGES_SQL.replace("ORDER BY dst_id", f"ORDER BY {_sql_id(catalogue.REACHED_SQL, 'dst_id')}")


@query(f"""WITH {ONE_STAGE1}, {ONE_EDGES}, k AS (SELECT entity_type, id, distance, row_number() OVER (ORDER BY round(CASE WHEN entity_type = 'verse' THEN distance - 0.05 ELSE distance END, 9), stage, round(distance, 9), entity_type, {_sql_id('entity_type', 'id')}) AS position
        FROM al WHERE entity_type = 'verse' OR EXISTS (SELECT 1 FROM u WHERE u.id = al.id AND u.entity_type = al.entity_type))
    SELECT entity_type, {_sql_id('entity_type', 'id')} AS id, CASE WHEN entity_type IN ('topical_guide', 'bible_dict', 'index') THEN 'n' || id WHEN entity_type = 'verse' THEN 'r' || id ELSE '' END AS name,
        CASE WHEN entity_type = 'chapter' THEN 's' || id WHEN entity_type IN ('topical_guide', 'index') THEN '' ELSE 't' || id END AS text, {catalogue.NEAR},
        CASE WHEN entity_type = 'verse_group' THEN 'ch/a/b/' || id END AS chapter_id, CASE WHEN entity_type = 'verse' THEN id::INT END AS verse_number, CASE WHEN entity_type = 'jst_passage' THEN '1-2' END AS comprises, position
    FROM k WHERE position <= 20""")
def search_results(spark, d):
    """The search for one text, with names, texts and metadata."""
    kept = store.GraphStore(spark, fresh_folder(spark, "edges"))
    kept.write({"drawn": catalogue.graph_edges(spark, d)})
    e = kept.table("drawn").withColumn("to", search.leads_to(F.col("src_type"), F.col("rel")))
    nodes = search_nodes(spark, d)
    known = search.result_nodes(nodes).select(F.col("entity_type").alias("known_type"), F.col("id").alias("known_id"))
    edges = e.select("src_type", ids_of(F.col("src_type"), F.col("src_id")).alias("src_id"), "rel", F.col("to").alias("dst_type"), ids_of(F.col("to"), F.col("dst_id")).alias("dst_id"))
    edges = edges.join(known, (F.col("dst_type") == F.col("known_type")) & (F.col("dst_id") == F.col("known_id")), "left_semi")  # edges lead to nodes
    kept.write({store.SEARCH_EDGES: edges}, {store.SEARCH_EDGES: store.Layout(8, store.EXPANDED_BY)})
    edges = kept.table(store.SEARCH_EDGES)
    found = search.search(nodes, edges, ASKED, FixedEmbedder(), 20)
    return found.select("entity_type", "id", "name", "text", catalogue.near(), F.col("metadata.chapterID").alias("chapter_id"), F.col("metadata.verseNumber").alias("verse_number"), F.col("metadata.comprises").alias("comprises"), F.col("position").cast("long").alias("position"))


# --- JSON -----------------------------------------------------------------------------------------------------------------------------------

KEY, AT = "'cannot get value for key {}: {}'", "'cannot get value for index 1: {}'"


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN (json_extract(props, '$.k')::BIGINT)::VARCHAR END AS value, CASE event_id % 6 WHEN 1 THEN {KEY.format('b', 'value is not a map')} WHEN 2 THEN {KEY.format('a', 'key not found')}
    WHEN 3 THEN {AT.format('index out of bounds')} WHEN 4 THEN 'not JSON' WHEN 5 THEN {AT.format('value is not an array')} END AS error FROM events""")
def json_accessor(spark, d):
    """A path into JSON whose errors are data; the documents wrap each event's properties in five wrong ways and a right one."""
    k, props = F.col("event_id") % 6, F.col("props")
    source = F.when(k == 0, corpus_queries.said('{"a": {"b": [0, ', F.get_json_object(props, "$.k"), "]}}")).when(k == 1, corpus_queries.said('{"a": [', props, "]}")).when(k == 2, props)
    source = source.when(k == 3, corpus_queries.said('{"a": {"b": [', props, "]}}")).when(k == 4, corpus_queries.said("x", props)).otherwise(corpus_queries.said('{"a": {"b": ', props, "}}"))
    found = accessor(source).get("a").get("b").index(1).value()
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", found["value"].cast("string").alias("value"), found["error"].alias("error"))


@query("""SELECT s_suppkey, x.name, x.value FROM (SELECT s_suppkey, s_suppkey % 3 AS n, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS w FROM supplier), LATERAL (SELECT * FROM (VALUES ('verse', n::VARCHAR), ('book', w), ('summary', CASE WHEN n = 1 THEN 'one' END)) t(name, value)) x WHERE x.value <> ''""")
def shown_metadata(spark, d):
    """Of named values those that are shown: 0 is, null, '' and the url aren't."""
    n = (F.col("s_suppkey") % 3).cast("int")
    row = F.struct(n.alias("verse"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("book"), F.when(n == 1, "one").alias("summary"), F.lit("http://u").alias("url"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.explode(shown_values(named_values(row))).alias("name", "v"))
    return rows.select("s_suppkey", "name", F.col("v").cast("string").alias("value"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN NULL ELSE string_agg('o' || o_orderkey, ' ' ORDER BY o_orderkey) END AS made, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'P')::VARCHAR AS error,
    string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey""")
def list_helpers(spark, d):
    """A change of each element of a list, or the first element that can't be changed; keys of a map."""
    order = F.struct("o_orderkey", "o_orderstatus")
    held = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("l"))
    made = collections.map_checked(F.col("l"), lambda x: F.concat(F.lit("o"), x["o_orderkey"].cast("string")), lambda x: F.when(x["o_orderstatus"] == "P", x["o_orderkey"].cast("string")))
    statuses = collections.keys(F.map_from_arrays(collections.dedupe(F.col("l.o_orderstatus")), collections.dedupe(F.col("l.o_orderstatus"))))
    return held.select("o_custkey", F.array_join(made["values"], " ").alias("made"), made["error"].alias("error"), F.array_join(statuses, "").alias("statuses"))


# --- embedding and files --------------------------------------------------------------------------------------------------------------------


class RefusingEmbedder:
    """The length of a text and its first letter; texts that begin with a vowel are refused, and with them their batch."""

    def embed_batch(self, texts):
        if any(t[0] in "aeiou" for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), float(ord(t[0]))] for t in texts]


@query("""SELECT 'p/' || p_partkey AS id, CASE WHEN left(t, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN [length(t)::FLOAT, ascii(t)::FLOAT]::FLOAT[] END AS embedding, CASE WHEN left(t, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'refused' END AS error
    FROM (SELECT p_partkey, left(lower(p_name) || ' ' || p_type, 12) AS t FROM part)""")
def embedded_nodes(spark, d):
    """Texts cut to a length and embedded in batches, several under way in each task; a batch that fails is tried again text by text."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(corpus_queries.said("p/", F.col("p_partkey")).alias("id"), F.concat_ws(" ", F.lower("p_name"), "p_type").alias("text"))
    return embeddings.embed(rows, RefusingEmbedder(), batch=16, most=12, in_flight=3, cluster_limit=24)


@query("SELECT 'c/' || o_custkey AS id, sha256(arg_max(o_orderpriority, o_orderkey)) AS digest, max(o_orderkey)::BIGINT AS version FROM orders GROUP BY o_custkey")
def stream_keyed_embedding(spark, d):
    """Each order says anew what its customer's text is: the first half of the orders, then all of them as a stream that knows what it has seen."""
    at = fresh_folder(spark, "keyed")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(corpus_queries.said("c/", F.col("o_custkey")).alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").cast("long").alias("version"))
    for part in ("version % 2 = 0", "true"):
        rows.where(part).write.mode("append").parquet(f"{at}/in")
        keyed.run(spark, f"{at}/in", f"{at}/out", FixedEmbedder()).awaitTermination()
    newest = rows.groupBy(F.col("id").alias("of")).agg(F.max("version").alias("newest"))  # repeats of a text leave the version that it was embedded at
    return keyed.current(spark, f"{at}/out").join(newest, F.col("id") == F.col("of")).select("id", "digest", F.col("newest").alias("version"))


@query(f"WITH {corpus_queries.V} SELECT 'ot' AS volume, 'gen' AS slug, c AS file_number, CASE WHEN c % 2 = 0 THEN 'S' || c ELSE '' END AS summary, count(*)::INT AS n_verses, md5(string_agg(text, '|' ORDER BY n)) AS digest FROM v GROUP BY c")
def chapter_file_tree(spark, d):
    """Chapters written as files, <volume>/<slug>/<number>.json, and read again."""
    at = fresh_folder(spark, "chapters")
    files.register(spark)
    corpus_queries.chapters(spark, d).write.format("chapter_files").mode("append").save(at)
    rows = corpus.read_chapters(spark, at)
    return rows.select("volume", "slug", "file_number", "summary", F.size("verses").alias("n_verses"), F.md5(F.array_join("verses.text", "|").cast("binary")).alias("digest"))
