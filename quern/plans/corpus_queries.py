"""Queries that run the load and the page readers over source rows made from the given tables, with the same in SQL.

Each conversation is a chapter of one book and its turns are the verses; footnotes of every kind hang on them. Parts give topics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import mutations, paging, predicates, search
from ..sources import pages
from ..sources.shared import fresh_folder
from . import load, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOPICS = 5


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def said(*parts: Column | str) -> Column:
    """Text put together from columns and constants."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def note(category: str, reference: str, words: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(reference).alias("reference_text"), words.alias("text"))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Rows like those of chapter files."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    verse = F.struct((F.col("turn") + 1).cast("int").alias("number"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("footnote_markers"))
    rows = turns.groupBy(F.col("conv_id").cast("int").alias("chapter")).agg(F.array_sort(F.collect_list(verse)).alias("verses"))
    c = F.col("chapter")
    notes = {
        "1a": note("cross-ref", "see", said("Gen. ", c, ":2–3; Gen. ", c, ":999; Gen. ", c, ":2. TG Faith.")),
        "1c": note("trn", "", said("HEB w", c)),
        "2b": note("tg, bd", "", said("TG Topic ", c % TOPICS, "; Missing. BD Ark.")),
        "3d": note("jst", "", said("JST Gen. ", c, ":1–2 (x).")),
        "zz": note("or", "", F.lit("no verse")),
    }
    return rows.select(
        F.lit("").alias("url"), F.lit("Genesis").alias("book"), "chapter", F.when(c % 2 == 0, said("S", c)).otherwise("").alias("summary"), "verses",
        F.create_map(*(x for k, v in notes.items() for x in (F.lit(k), v))).alias("footnotes"), F.lit("ot").alias("volume"), F.lit("gen").alias("slug"), c.alias("file_number"),
    )


def studies(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Rows like those of the study files: a topic and an index entry for each part, a dictionary entry for each supplier, a translation for
    each conversation."""
    k = F.col("k")
    keys = lambda table, key: spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).cast("int").alias("k")).distinct()
    line = lambda phrase, reference, key: F.struct(F.lit(phrase).alias("phrase"), reference.alias("reference"), key.alias("key"))
    own, none = said("Gen. ", k, ":1"), F.lit("")
    lines = F.array(line("p", own, none), line("", F.lit("TG"), said("Topic ", k + 1)), line("", F.lit("BD"), F.lit("Ark")), line("q", own, none), line("", F.lit("TG"), F.lit("None")))
    topics = keys("part", "p_partkey").select(said("Topic ", k).alias("name"), k.alias("pos"), lines.alias("value"))
    seen = F.array(line("i", said("Gen. ", k, ":1, 3"), none), line("", F.lit("IDX"), F.lit("Index 0")), line("", F.lit("TG"), F.lit("Topic 1")), line("", F.lit("BD"), F.lit("Ark")))
    index = keys("part", "p_partkey").select(said("Index ", k).alias("name"), k.alias("pos"), seen.alias("value"))
    cited = F.struct(F.lit("a box").alias("text"), F.array(said("Gen. ", k, ":1–2"), F.lit("nonsense")).alias("references"))
    entries = keys("supplier", "s_suppkey").select(F.when(k == 0, "Ark").otherwise(said("Entry ", k)).alias("name"), k.alias("pos"), cited.alias("value"))
    verse = lambda n, words: F.struct(F.lit(n).alias("number"), F.lit(words).alias("text"))
    parts = F.array(F.struct(F.lit("").alias("comprises"), said("Gen. ", k, ":1-2").alias("compare"), F.lit("").alias("summary"), F.array(verse(1, "a"), verse(2, "b")).alias("verses")))
    translations = keys("conversations", "conv_id").select(F.lit("").alias("reference"), F.when(k == 4, "Nowhere").otherwise("Genesis").alias("book"), k.cast("string").alias("chapter"), parts.alias("entries"), k.alias("pos"))
    return {"topics": topics, "entries": entries, "index": index, "translations": translations}


def graph(spark: SparkSession, d: str, every: bool = False) -> load.Graph:
    return load.load_tables(chapters(spark, d), studies(spark, d), every)


V = "v AS (SELECT conv_id::INT AS c, (turn + 1)::INT AS n, coalesce(text, '') AS text, 'v/ot/gen/' || conv_id || '/' || (turn + 1) AS id FROM conversations), ch AS (SELECT DISTINCT c FROM v)"
K = "k AS (SELECT p_partkey::INT AS k FROM part), ks AS (SELECT s_suppkey::INT AS k, CASE WHEN s_suppkey = 0 THEN 'Ark' ELSE 'Entry ' || s_suppkey END AS name FROM supplier), kt AS (SELECT DISTINCT conv_id::INT AS k FROM conversations)"


@query(f"""WITH {V} SELECT id, n AS number, 'Gen. ' || c || ':' || n AS reference, md5(text) AS digest, CASE WHEN n = 1 THEN '[{{"marker":"c","hebrew_text":"HEB w' || c || '"}}]' END AS "translationNotes" FROM v""")
def load_verses(spark, d):
    return graph(spark, d).nodes["Verse"].select("id", "number", "reference", F.md5(F.col("text").cast("binary")).alias("digest"), "translationNotes")


@query(f"WITH {V} SELECT 'ch/ot/gen/' || c AS id, c AS number, CASE WHEN c % 2 = 0 THEN 'S' || c END AS summary, NULL::VARCHAR AS url FROM ch")
def load_chapters(spark, d):
    return graph(spark, d).nodes["Chapter"].select("id", "number", "summary", "url")


@query("SELECT 'book/ot/gen' AS id, 'Genesis' AS name, 'gen' AS slug, '/study/scriptures/ot/gen' AS \"urlPath\"")
def load_books(spark, d):
    return graph(spark, d).nodes["Book"]


@query(f"WITH {V} SELECT 'vol/ot' AS src_id, 'book/ot/gen' AS dst_id UNION ALL SELECT 'book/ot/gen', 'ch/ot/gen/' || c FROM ch")
def load_contains(spark, d):
    return graph(spark, d).edges["CONTAINS"]


@query(f"WITH {V} SELECT 'ch/ot/gen/' || c AS src_id, id AS dst_id FROM v")
def load_has_verse(spark, d):
    return graph(spark, d).edges["HAS_VERSE"]


GROUPS = f"""{V}, s AS (SELECT c, k * 3 + 1 AS first, m FROM (SELECT c, max(n) AS m FROM v GROUP BY c), range(0, 100) r(k) WHERE k = 0 OR k * 3 + 2 < m),
    g AS (SELECT c, first, least(first + 4, m) AS last, 'vg/ot/gen/' || c || '/' || first || '-' || least(first + 4, m) AS id FROM s)"""


@query(f"WITH {GROUPS} SELECT g.id AS src_id, v.id AS dst_id FROM g JOIN v ON v.c = g.c AND v.n BETWEEN first AND last")
def load_includes(spark, d):
    return graph(spark, d).edges["INCLUDES"]


@query(f"WITH {GROUPS} SELECT 'ch/ot/gen/' || c AS src_id, id AS dst_id FROM g")
def load_has_group(spark, d):
    return graph(spark, d).edges["HAS_GROUP"]


@query(f"""WITH {V} SELECT a.id AS src_id, b.id AS dst_id, 'cross-ref' AS category, '1a' AS "footnoteMarker", 'see' AS "referenceText", coalesce(e.id, '') AS "targetEndVerseId"
    FROM v a JOIN v b ON b.c = a.c AND b.n = 2 LEFT JOIN v e ON e.c = a.c AND e.n = 3 WHERE a.n = 1""")
def load_cross_references(spark, d):
    return graph(spark, d).edges["CROSS_REF"]


@query(f"""WITH {V} SELECT id AS src_id, 'tg/Topic ' || (c % 5) AS dst_id, '2b' AS "footnoteMarker", 'Topic ' || (c % 5) AS "tgTopicText", '' AS "referenceText" FROM v WHERE n = 2""")
def load_topic_footnotes(spark, d):
    return graph(spark, d).edges["TG_FOOTNOTE"]


@query(f"""WITH {V} SELECT id AS src_id, 'bd/Ark' AS dst_id, '2b' AS "footnoteMarker" FROM v WHERE n = 2""")
def load_dictionary_footnotes(spark, d):
    return graph(spark, d).edges["BD_FOOTNOTE"]


@query(f"""WITH {V} SELECT id AS src_id, 'jst/gen/' || c || '/1-2' AS dst_id, '3d' AS "footnoteMarker" FROM v WHERE n = 3 AND c <> 4""")
def load_translation_footnotes(spark, d):
    return graph(spark, d).edges["JST_FOOTNOTE"]


@query(f"WITH {K} SELECT 'tg/Topic ' || k AS src_id, 'tg/Topic ' || (k + 1) AS dst_id, 'TG_SEE_ALSO' AS rel FROM k WHERE k + 1 IN (SELECT k FROM k) UNION ALL SELECT 'tg/Topic ' || k, 'bd/Ark', 'TG_BD_REF' FROM k UNION ALL SELECT 'idx/Index ' || k, 'idx/Index 0', 'IDX_SEE_ALSO' FROM k UNION ALL SELECT 'idx/Index ' || k, 'tg/Topic 1', 'IDX_TG_REF' FROM k UNION ALL SELECT 'idx/Index ' || k, 'bd/Ark', 'IDX_BD_REF' FROM k")
def load_see_also(spark, d):
    edges = graph(spark, d).edges
    parts = [edges[k].select("src_id", "dst_id", F.lit(k).alias("rel")) for k in ("TG_SEE_ALSO", "TG_BD_REF", "IDX_SEE_ALSO", "IDX_TG_REF", "IDX_BD_REF")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query(f"WITH {V}, {K} SELECT 'tg/Topic ' || k AS src_id, id AS dst_id, 'p' AS phrase FROM k JOIN v ON c = k AND n = 1 UNION ALL SELECT 'idx/Index ' || k, id, 'i' FROM k JOIN v ON c = k AND n IN (1, 3)")
def load_verse_references(spark, d):
    edges = graph(spark, d).edges
    return edges["TG_VERSE_REF"].unionByName(edges["IDX_VERSE_REF"])


@query(f"""WITH {V}, {K} SELECT 'bd/' || name AS src_id, a.id AS dst_id, coalesce(b.id, '') AS "targetEndVerseId" FROM ks JOIN v a ON a.c = k AND a.n = 1 LEFT JOIN v b ON b.c = k AND b.n = 2""")
def load_dictionary_references(spark, d):
    return graph(spark, d).edges["BD_VERSE_REF"]


@query(f"WITH {V} SELECT 'jst/gen/' || c || '/1-2' AS src_id, id AS dst_id FROM v WHERE c <> 4 AND n IN (1, 2)")
def load_compared_verses(spark, d):
    return graph(spark, d).edges["COMPARES"]


@query(f"""WITH {K} SELECT 'jst/' || CASE WHEN k = 4 THEN '' ELSE 'gen' END || '/' || k || '/1-2' AS id, CASE WHEN k = 4 THEN 'Nowhere' ELSE 'Genesis' END AS book, k::VARCHAR AS chapter, '1-2' AS comprises, 'Gen. ' || k || ':1-2' AS "compareRef", 'a b' AS text FROM kt""")
def load_translations(spark, d):
    return graph(spark, d).nodes["JSTPassage"].select("id", "book", "chapter", "comprises", "compareRef", "text")


@query(f"""WITH {V}, {K}, m AS (SELECT c, max(n) AS m FROM v GROUP BY c), r AS (
    SELECT 'footnotes' AS phase, 'key without a verse' AS kind, 'zz' AS detail FROM ch
    UNION ALL SELECT 'footnotes', 'verse not found', 'v/ot/gen/' || c || '/' || x FROM m, (VALUES (2), (3)) t(x), (VALUES (1), (2)) u(y) WHERE m < x AND (x = 2 OR y = 1)
    UNION ALL SELECT 'footnotes', 'verse not found', 'ot/gen ' || c || ':999' FROM ch
    UNION ALL SELECT 'footnotes', 'verse not found', 'ot/gen ' || c || ':2' FROM m, (VALUES (1), (2)) u(y) WHERE m < 2
    UNION ALL SELECT 'footnotes', 'topic not found', 'Missing' FROM m WHERE m >= 2
    UNION ALL SELECT 'references', 'topic not found', 'None' FROM k
    UNION ALL SELECT 'references', 'topic not found', 'Topic ' || (k + 1) FROM k WHERE k + 1 NOT IN (SELECT k FROM k)
    UNION ALL SELECT 'references', 'citation', 'cannot parse reference: nonsense' FROM ks
    UNION ALL SELECT 'study helps', 'unknown translation book', 'Nowhere' FROM kt WHERE k = 4
    UNION ALL SELECT 'references', 'verse not found', 'ot/gen ' || k || ':1' FROM k, (VALUES (1), (2), (3)) u(y) WHERE k NOT IN (SELECT c FROM ch)
    UNION ALL SELECT 'references', 'verse not found', 'ot/gen ' || k || ':1' FROM ks WHERE k NOT IN (SELECT c FROM ch)
    UNION ALL SELECT 'references', 'verse not found', 'ot/gen ' || k || ':3' FROM k LEFT JOIN m ON c = k WHERE m IS NULL OR m < 3)
    SELECT phase, kind, detail, count(*) AS n FROM r GROUP BY ALL""")
def load_rejects(spark, d):
    return graph(spark, d).all_rejects().groupBy("phase", "kind", "detail").agg(F.count("*").alias("n"))


def counted(name: str, query: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS name, (SELECT count(*) FROM ({ORACLE_SQL[query]}) WHERE {where})::BIGINT AS rows"


COUNTS = [
    ("Verse", "load_verses"), ("Chapter", "load_chapters"), ("JSTPassage", "load_translations"), ("CONTAINS", "load_contains"), ("HAS_VERSE", "load_has_verse"), ("HAS_GROUP", "load_has_group"), ("VerseGroup", "load_has_group"),
    ("INCLUDES", "load_includes"), ("CROSS_REF", "load_cross_references"), ("TG_FOOTNOTE", "load_topic_footnotes"), ("BD_FOOTNOTE", "load_dictionary_footnotes"), ("JST_FOOTNOTE", "load_translation_footnotes"),
    ("BD_VERSE_REF", "load_dictionary_references"), ("COMPARES", "load_compared_verses"), *((r, "load_see_also", f"rel = '{r}'") for r in ("TG_SEE_ALSO", "TG_BD_REF", "IDX_SEE_ALSO", "IDX_TG_REF", "IDX_BD_REF")),
    ("TG_VERSE_REF", "load_verse_references", "src_id LIKE 'tg/%'"), ("IDX_VERSE_REF", "load_verse_references", "src_id LIKE 'idx/%'"),
]


@query(" UNION ALL ".join(counted(*c) for c in COUNTS) + f""" UNION ALL SELECT name, n FROM (WITH {V}, {K} SELECT 'Volume' AS name, 5::BIGINT AS n UNION ALL SELECT 'Book', least(1, count(*)) FROM ch
    UNION ALL SELECT 'TopicalGuideEntry', count(*) FROM k UNION ALL SELECT 'IndexEntry', count(*) FROM k UNION ALL SELECT 'BibleDictEntry', count(*) FROM ks UNION ALL SELECT 'BD_SEE_ALSO', 0)
    UNION ALL SELECT 'rejects', sum(n)::BIGINT FROM ({ORACLE_SQL["load_rejects"]})""")
def load_counts(spark, d):
    """Rows of all outputs, as they were counted while the graph was written."""
    counters = store.Counters()
    store.save_graph(store.GraphStore(spark, fresh_folder(spark, "counts")), graph(spark, d, every=True), 8, counters=counters)
    rows = [(name.split("/")[-1], o.get["rows"]) for name, o in counters.seen.items()]
    return spark.createDataFrame(rows, "name string, rows long")


@query(f"WITH {V} SELECT id, CASE WHEN c % 2 = 0 THEN [c::FLOAT, 1.0::FLOAT]::FLOAT[] END AS vector, c % 2 = 0 AS named FROM (SELECT 'ch/ot/gen/' || c AS id, c FROM ch)")
def store_write_back(spark, d):
    """A graph written as one version; vectors written back as the next, computed from the table that they replace."""
    kept = store.GraphStore(spark, fresh_folder(spark, "store"))
    store.save_graph(kept, graph(spark, d, every=True), 8)
    chapters_now = store.open_graph(kept)
    named = chapters_now.nodes["Chapter"].where("summary is not null").select("id", F.array(F.col("number").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    store.save_vectors(kept, "Chapter", load.with_vectors(chapters_now, "Chapter", named))
    return kept.table("nodes/Chapter").select("id", F.col("summaryEmbedding").alias("vector"), F.col("summary").isNotNull().alias("named"))


def page(spark: SparkSession, d: str, html: Column, name: str = "part", key: str = "p_partkey", url: Column | None = None) -> DataFrame:
    """page_id and html (and url) made from a table's rows. The table is a small file that one task would read, its pages are not: its rows are dealt out first."""
    rows = spark.read.parquet(f"{d}/{name}.parquet").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select(F.col(key).alias("page_id"), html.alias("html"), *([] if url is None else [url.alias("url")]))


@query("""SELECT p_partkey AS page_id, p_name AS title, x.i AS nth, x.phrase, x.reference, x.key FROM part, LATERAL (SELECT * FROM (VALUES (0, '', 'TG', p_type), (1, '', 'GS', p_brand),
    (2, '', 'BD', 'Ark'), (3, 'of ' || p_brand, 'Ex. ' || p_size || ':5 (34:7; Deut. 5:9)', ''), (4, 'more', 'Ex. 21:2', '')) t(i, phrase, reference, key)) x""")
def page_entries(spark, d):
    def link(path: str, *words: Column | str) -> Column:
        return said(f'<a class="scripture-ref" href="/study/scriptures/{path}">', *words, "</a>")

    brand, size = F.col("p_brand"), F.col("p_size")
    under_title = said('<p class="title">See ', link("tg/x", F.col("p_type")), "; ", link("gs/x", "<small>GS</small> ", brand), "; ", link("bd/ark", "Ark"), "</p>")
    first = said('<p class="entry">of ', brand, ", ", link("ot/ex/20", "Ex. ", size, ":5"), " (", link("ot/ex/34", "34:7"), "; ", link("ot/deut/5", "Deut. 5:9"), ").</p>")
    second = said('<p class="entry">more, ', link("ot/ex/21", "21:2"), ".</p>")
    html = said("<article><h1>", F.col("p_name"), '</h1><div class="body-block">', under_title, first, second, "</div></article>")
    rows = pages.entries(page(spark, d, html))
    return rows.select("page_id", "title", F.posexplode("entries").alias("nth", "e")).select("page_id", "title", "nth", "e.phrase", "e.reference", "e.key")


@query("""SELECT p_partkey AS page_id, p_name AS book, p_size AS chapter, p_type AS summary, 2 AS n_verses, p_brand || ' was first' AS first_text, 'a' AS mark, '1a' AS note_key, 'cross-ref, tg' AS category, 'Ex. ' || p_size || ':1 TG X' AS note_text, 'was' AS reference_text FROM part""")
def page_chapters(spark, d):
    brand, size = F.col("p_brand"), F.col("p_size")
    verse = said('<p class="verse"><span class="verse-number">1 </span>', brand, ' <span class="iconPointer-x">no</span><a class="study-note-ref" href="#note1a"><sup class="marker" data-value="a">a</sup>was</a> first</p><p class="verse"><span class="verse-number">2 </span>two</p>')
    notes = said('<footer class="study-notes"><ul><li id="note1a" data-full-marker="1a"><p><span data-note-category="cross-ref"><a href="/study/scriptures/ot/ex/1">Ex. ', size, ':1</a></span> <span data-note-category="tg">TG X</span></p></li></ul></footer>')
    html = said('<h1><span class="dominant">', F.col("p_name"), '</span></h1><p class="title-number">Chapter ', size, '</p><p class="study-summary">', F.col("p_type"), "</p>", verse, notes)
    c = pages.extract(page(spark, d, html), "chapter").select("page_id", "content.*")
    first, noted = F.get("verses", F.lit(0)), F.get("footnotes", F.lit(0))
    return c.select(
        "page_id", "book", "chapter", "summary", F.size("verses").alias("n_verses"), first["text"].alias("first_text"), F.get(first["footnote_markers"], F.lit(0)).alias("mark"),
        noted["key"].alias("note_key"), noted["category"].alias("category"), noted["text"].alias("note_text"), noted["reference_text"].alias("reference_text"),
    )


@query("""SELECT p_partkey AS page_id, p_name AS title, p_type || CHR(10) || CHR(10) || 'see ' || p_brand || ' or TG' AS text, p_brand AS reference, 1 AS n FROM part""")
def page_dictionary(spark, d):
    html = said("<article><h1>", F.col("p_name"), '</h1><div class="body-block"><p>', F.col("p_type"), '</p><p>see <a class="scripture-ref" href="/study/scriptures/ot/gen/1">', F.col("p_brand"), '</a> or <a class="scripture-ref" href="/study/scriptures/tg/x">TG</a></p></div></article>')
    c = pages.extract(page(spark, d, html), "dictionary").select("page_id", "content.*")
    return c.select("page_id", "title", "text", F.get("references", F.lit(0)).alias("reference"), F.size("references").alias("n"))


@query("""SELECT p_partkey AS page_id, 0 AS nth, 'Genesis' AS book, CASE WHEN p_size % 2 = 0 THEN '1-' || p_size ELSE '99:1-' || p_size END AS comprises, p_brand AS compare, p_type AS summary, 1 AS n_verses FROM part""")
def page_translations(spark, d):
    size = F.col("p_size")
    chapter = F.when(size % 2 == 0, size).otherwise(99)
    html = said("<article><section><header><h2><strong>JST, Genesis ", chapter, ":1–", size, '.</strong> Compare <a class="scripture-ref" href="/x">', F.col("p_brand"), '</a></h2><p class="study-intro">', F.col("p_type"), '</p></header><p class="verse"><span class="verse-number">1</span> x</p></section><section><h2>none</h2></section></article>')
    made = pages.translations(page(spark, d, html, url=said("https://h/study/scriptures/jst/jst-gen/", size, "?lang=eng")))
    return made.select("page_id", "nth", "book", "comprises", "compare", "summary", F.size("verses").alias("n_verses"))


@query("""SELECT p_partkey AS page_id, 'Morning' AS session, 't' || p_size AS slug, 2024 AS year, 4 AS month, p_name AS title, p_brand AS speaker FROM part UNION ALL SELECT p_partkey, 'Morning', 'lone', 2024, 4, p_type, '' FROM part""")
def page_sessions(spark, d):
    base = '<a href="/study/general-conference/2024/04/'
    talk = said(base, "t", F.col("p_size"), '?lang=eng"><span>', F.col("p_name"), "</span><p>", F.col("p_brand"), "</p></a>")
    html = said('<ul><li data-content-type="general-conference-session">', base, 'morning-session"><p class="title">Morning</p></a>', talk, talk, base, 'lone"><p>', F.col("p_type"), "</p></a></li><li>", base, 'out">x</a></li></ul>')
    rows = pages.extract(page(spark, d, html), "sessions").select("page_id", F.explode("content").alias("t"))
    return rows.select("page_id", "t.session", "t.slug", "t.year", "t.month", "t.title", "t.speaker")


@query("""SELECT p_partkey AS page_id, p_name AS title, p_brand AS speaker, 'Of ' || p_type AS role, 'kick' AS kicker, 'p1' AS id, 'First words' AS text, '1' AS mark, 1 AS n_paragraphs FROM part""")
def page_talks(spark, d):
    html = said("<article><h1>", F.col("p_name"), '</h1><p class="author-name">By ', F.col("p_brand"), '</p><p class="author-role">Of ', F.col("p_type"), '</p><p class="kicker">kick</p><div class="body-block"><p id="p1">First<sup class="marker">1</sup> words</p></div></article>')
    c = pages.extract(page(spark, d, html), "talk").select("page_id", "content.*")
    first = F.get("paragraphs", F.lit(0))
    return c.select("page_id", "title", "speaker", "role", "kicker", first["id"].alias("id"), first["text"].alias("text"), F.get(first["footnote_markers"], F.lit(0)).alias("mark"), F.size("paragraphs").alias("n_paragraphs"))


@query("SELECT o_orderkey, 'Ex. ' || (o_orderkey % 40) || ':3' AS first, 'Ex. ' || (o_orderkey % 40) || ':7-9' AS second, 'Ex.' AS book FROM orders")
def reference_parts(spark, d):
    k = F.col("o_orderkey")
    parts = text.split_composite(said("Ex. ", k % 40, ":3, 7-9"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"), text.book_prefix(F.get(parts, F.lit(0))).alias("book"))


@query("""SELECT o_orderkey, 'Gen. ' || o_orderkey || ':1' AS cross_part, 'Faith' || (o_orderkey % 7) AS topic, 'Ark ' || (o_orderkey % 5) AS entry, 'Gen. 1:' || (o_orderkey % 9) AS jst FROM orders""")
def footnote_parts(spark, d):
    k = F.col("o_orderkey")
    note_text = said("Gen. ", k, ":1. TG Faith", k % 7, "; Hope. BD Ark ", k % 5, ". JST Gen. 1:", k % 9, " (Appendix).")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", text.cross_reference_part(note_text).alias("cross_part"), F.get(text.topics(note_text), F.lit(0)).alias("topic"), text.dictionary_entry(note_text).alias("entry"), text.translation_reference(note_text).alias("jst")
    )


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'v' || c_custkey END AS name, c_acctbal AS size FROM customer UNION ALL SELECT -n_nationkey - 1, n_name, NULL FROM nation")
def mutation_create_and_write_back(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.col("c_acctbal").alias("size"))
    changes = customer.where("id % 3 = 0").select("id", said("v", F.col("id")).alias("name"))
    nations = spark.read.parquet(f"{d}/nation.parquet").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"))
    return mutations.create(mutations.update_from(customer, changes), nations)


@query("SELECT l_orderkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey % 2 = 0")
def mutation_connect_and_disconnect(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"))
    made = mutations.connect_rows(rows.limit(0), rows, orders, parts, "drop")[0]
    return mutations.disconnect(made, rows.where("dst_id % 2 = 1").distinct())


@query("SELECT vec_id AS id, printf('(%.3f) chapter [%s]: t%s', label / 8.0, vec_id::VARCHAR, label::VARCHAR) AS line FROM embeddings")
def printed_results(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit("chapter").alias("entity_type"), (F.col("label") / 8.0).alias("distance"), said("t", F.col("label")).alias("text"))
    return search.sort_by_distance(rows).select("id", search.printable(rows).alias("line"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def listed_nodes(spark, d):
    customer = predicates.Label(spark.read.parquet(f"{d}/customer.parquet"), "c_custkey")
    return paging.list_nodes(customer, {"c_acctbal_gt": 0.0}, [{"c_name": "DESC"}]).select("c_custkey", "c_name")


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def rfc3339_parse(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_timestamp(text.from_rfc3339(text.rfc3339(F.col("ts")))).alias("seconds"))


@query("SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1] AS chapter, len(list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) >= 5 AS is_chapter FROM pages")
def url_parts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.chapter_of_url(F.col("url")).alias("chapter"), text.is_chapter_url(F.col("url")).alias("is_chapter"))


@query("SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1) AS host, (CASE page_id % 3 WHEN 0 THEN 6379 WHEN 1 THEN 7000 + page_id % 100 END)::INT AS port FROM pages")
def host_and_port(spark, d):
    port = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, said(":", 7000 + F.col("page_id") % 100)).otherwise(":x")
    address = said(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1), port, "/graph")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.host_and_port(address).alias("a")).select("page_id", "a.*")


@query("""SELECT o_orderkey, 'talk' || (o_orderkey % 99) AS slug, CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 3 < 2 THEN month(o_orderdate)::INT END AS month,
    CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) || '-10' WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) || '-04' ELSE (year(o_orderdate) - 1) || '-10' END AS conference FROM orders""")
def conference_scalars(spark, d):
    """Slugs of talks, year and month of texts, and the latest conference before a date."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    url = said("https://h.org/study/general-conference/", F.year(day), "/", F.month(day), "/talk", k % 99, "?lang=eng")
    written = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM")).when(k % 3 == 1, said(" ", F.year(day), "/", F.month(day))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    found = text.year_month(written)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.talk_slug(url).alias("slug"), found["year"].alias("year"), found["month"].alias("month"), text.latest_conference(day).alias("conference"))


@query("""SELECT title, string_agg(page_id::VARCHAR, ' ' ORDER BY page_id) AS appended, max(page_id)::VARCHAR AS last FROM (SELECT p_partkey AS page_id, 'T' || p_size AS title FROM part) GROUP BY title""")
def pages_of_one_title(spark, d):
    """Entries of pages that share a title: all in page order, or those of the last page."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"), said("T", F.col("p_size")).alias("title"), F.array(F.col("p_partkey").cast("string")).alias("entries"))
    every, last = pages.merged_titles(rows, "n", append=True), pages.merged_titles(rows, "n", append=False)
    last = last.select(F.col("title").alias("of"), F.array_join("entries", " ").alias("last"))
    return every.join(last, F.col("title") == F.col("of")).select("title", F.array_join("entries", " ").alias("appended"), "last")
