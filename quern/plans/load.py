"""From the source tree to node and edge tables, in one pass over the files.

The exploded verses and footnotes are derived once; every node and edge table is a projection or a join of them. Joins
with names and verses are left to the optimizer, which broadcasts a side when it measures it to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import books, ids, text
from ..functions.references import explode_references
from ..operators.lookups import expand_range, first_match, first_of_pairs, lookup, sorted_side, split_categories, with_range_end
from ..operators.model import Field, Model
from ..operators.mutations import update_from
from ..operators.windows import sliding_groups
from ..sources import corpus, schemas
from ..sources.shared import fresh_folder


@dataclass
class Graph:
    """Label to nodes, relationship type to edges, and what was rejected."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    rejects: list[DataFrame] = field(default_factory=list)
    #: What is done with rows that several tables are made of; `written` where all tables are wanted.
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def model(self) -> Model:
        """The graph as selections and nested mutations read it."""
        properties = {r.type: tuple(p.split()[0] for p in r.properties.split(", ")) if r.properties else () for r in schemas.RELATIONSHIPS}
        return Model(self.nodes, self.edges, [Field(label, name, kind, target, inward, properties[kind]) for label, name, kind, target, inward in schemas.FIELDS])

    def reject(self, rows: DataFrame, phase: str, kind: str, detail: Column) -> None:
        self.rejects.append(rows.select(F.lit(phase).alias("phase"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))

    def all_rejects(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.rejects)

    def counts(self) -> DataFrame:
        """Rows of each output: what a load reports."""
        tables = {**self.nodes, **self.edges}
        return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(k).alias("name"), "rows") for k, t in tables.items()])


def _notes(notes: DataFrame, kind: str, name: str, label: str) -> DataFrame:
    own = notes.where(F.col("kind") == kind).groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("marker", F.col("note_text").alias(label)))).alias("n"))
    return own.select(F.col("verse_id").alias(f"of_{name}"), F.to_json("n").alias(name))


def load_scriptures(graph: Graph, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Volumes, books, chapters and verses with their containment; (verses with their natural key, footnotes by category)."""
    spark = chapters.sparkSession
    known = books.book_table(spark).select(F.col("volume").alias("kv"), F.col("slug").alias("ks"), F.col("abbreviation"))
    chapters = chapters.join(known, (F.col("volume") == F.col("kv")) & (F.col("slug") == F.col("ks")), "left").withColumn("abbreviation", F.coalesce("abbreviation", "slug"))
    graph.nodes["Volume"] = books.volume_table(spark).select("id", "name", "abbreviation")
    named = chapters.groupBy("volume", "slug").agg(F.min_by("book", F.struct("file_number", "chapter")).alias("book"), F.first("abbreviation").alias("abbreviation"))
    graph.nodes["Book"] = named.select(
        ids.book_id("volume", "slug").alias("id"), F.coalesce(F.nullif("book", F.lit("")), "abbreviation", "slug").alias("name"), "slug",
        F.concat_ws("/", F.lit(""), F.lit("study"), F.lit("scriptures"), "volume", "slug").alias("urlPath"),
    )
    graph.nodes["Chapter"] = chapters.select(
        ids.chapter_id("volume", "slug", "chapter").alias("id"), F.col("chapter").alias("number"), F.nullif("summary", F.lit("")).alias("summary"),
        F.lit(None).cast(schemas.VECTOR).alias("summaryEmbedding"), F.nullif("url", F.lit("")).alias("url"),
    )
    graph.edges["CONTAINS"] = named.select(ids.volume_id("volume").alias("src_id"), ids.book_id("volume", "slug").alias("dst_id")).unionByName(
        chapters.select(ids.book_id("volume", "slug").alias("src_id"), ids.chapter_id("volume", "slug", "chapter").alias("dst_id"))
    )
    verses = chapters.select("volume", "slug", "chapter", "abbreviation", F.posexplode("verses").alias("pos", "v"))
    verses = verses.select("volume", "slug", "chapter", "abbreviation", "pos", F.col("v.number").alias("number"), F.col("v.text").alias("text"))
    graph.reject(verses.where("coalesce(number, 0) = 0"), "scriptures", "verse without a number", F.concat_ws("/", "volume", "slug", "chapter", "pos"))
    verses = verses.where("number > 0").withColumn("id", ids.verse_id("volume", "slug", "chapter", "number"))
    verses = graph.keep(verses.groupBy("id").agg(F.min_by(F.struct("volume", "slug", "chapter", "abbreviation", "number", "text"), "pos").alias("v")).select("id", "v.*"))
    notes = chapters.select("volume", "slug", "chapter", F.explode("footnotes").alias("key", "note"))
    notes = notes.withColumn("k", text.footnote_key(F.col("key"))).select(
        "volume", "slug", "chapter", "key", F.col("k.verse").alias("number"), F.col("k.marker").alias("marker"), ids.verse_id("volume", "slug", "chapter", F.col("k.verse")).alias("verse_id"),
        F.col("note.category").alias("category"), F.col("note.text").alias("note_text"), F.coalesce("note.reference_text", F.lit("")).alias("reference_text"),
    )
    graph.reject(notes.where("number = 0"), "footnotes", "key without a verse", F.col("key"))
    notes = graph.keep(split_categories(notes.where("number > 0")))
    inline = {"translationNotes": ("trn", "hebrew_text"), "alternateReadings": ("or", "text"), "explanatoryNotes": ("ie", "text")}
    nodes = verses
    for name, (kind, label) in inline.items():
        nodes = nodes.join(_notes(notes.where("marker <> ''"), kind, name, label), F.col("id") == F.col(f"of_{name}"), "left")
    graph.nodes["Verse"] = nodes.select("id", "number", F.format_string("%s %d:%d", "abbreviation", "chapter", "number").alias("reference"), "text", *inline)
    graph.edges["HAS_VERSE"] = verses.select(ids.chapter_id("volume", "slug", "chapter").alias("src_id"), F.col("id").alias("dst_id"))
    return verses, notes


def load_groups(graph: Graph, verses: DataFrame) -> None:
    keys = ["volume", "slug", "chapter"]
    groups = sliding_groups(verses, keys, "number", "text").withColumn("id", ids.verse_group_id(*keys, "first", "last"))
    graph.nodes["VerseGroup"] = groups.select("id", "text", F.col("first").alias("startVerseNumber"), F.col("last").alias("endVerseNumber"), F.lit(None).cast(schemas.VECTOR).alias("embedding"))
    graph.edges["HAS_GROUP"] = groups.select(ids.chapter_id(*keys).alias("src_id"), F.col("id").alias("dst_id"))
    own = verses.select(*(F.col(k).alias(f"v_{k}") for k in keys), F.col("number"), F.col("id").alias("verse"))
    inside = groups.join(own, [F.col(k) == F.col(f"v_{k}") for k in keys] + [F.col("number").between(F.col("first"), F.col("last"))])
    graph.edges["INCLUDES"] = inside.select(F.col("id").alias("src_id"), F.col("verse").alias("dst_id"))


def read_studies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Source rows of topics, dictionary, index and translations; of missing files none."""
    return {
        "topics": corpus.read_map(spark, f"{root}/topical-guide.json", schemas.ENTRY_LIST),
        "entries": corpus.read_map(spark, f"{root}/bible-dictionary.json", schemas.DICTIONARY_ENTRY),
        "index": corpus.read_map(spark, f"{root}/triple-combination-index.json", schemas.ENTRY_LIST),
        "translations": corpus.read_list(spark, f"{root}/jst.json", schemas.TRANSLATION),
    }


def load_studies(graph: Graph, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Topics, dictionary, index and translation nodes; their source rows by name for the references."""
    none = F.lit(None).cast(schemas.VECTOR).alias("embedding")
    topics, entries, index, pages = (sources[k] for k in ("topics", "entries", "index", "translations"))
    spark = topics.sparkSession
    graph.nodes["TopicalGuideEntry"] = topics.select(ids.topic_id("name").alias("id"), "name", none)
    graph.nodes["BibleDictEntry"] = entries.select(ids.dictionary_id("name").alias("id"), "name", F.col("value.text").alias("text"), none)
    graph.nodes["IndexEntry"] = index.select(ids.index_id("name").alias("id"), "name", none)
    named = books.name_table(spark).select(F.col("name").alias("book_name"), F.col("slug"))
    pages = pages.join(named, F.col("book") == F.col("book_name"), "left").withColumn("slug", F.coalesce("slug", F.lit("")))
    graph.reject(pages.where("slug = ''"), "study helps", "unknown translation book", F.col("book"))
    parts = pages.select("book", "chapter", "slug", "pos", F.posexplode("entries").alias("nth", "e"))
    verses = F.array_join(F.transform(F.filter("e.verses", lambda v: F.coalesce(v.text, F.lit("")) != ""), lambda v: v.text), " ")
    first, last = F.get("e.verses.number", F.lit(0)), F.try_element_at("e.verses.number", F.lit(-1))
    guess = F.when(F.size("e.verses") <= 0, "unknown").when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
    parts = parts.select(
        "book", "chapter", "slug", "pos", "nth", F.col("e.compare").alias("compareRef"), F.coalesce("e.comprises", F.lit("")).alias("raw"), F.col("e.summary").alias("summary"),
        verses.alias("text"), F.coalesce(F.nullif("e.comprises", F.lit("")), guess).alias("comprises"),
    )
    graph.reject(parts.where("text = ''"), "study helps", "translation without text", F.concat_ws(" ", "book", "chapter", "comprises"))
    passages = parts.where("text <> ''").withColumn("id", ids.jst_id("slug", "chapter", "comprises"))
    graph.nodes["JSTPassage"] = passages.select("id", "book", "chapter", "comprises", "compareRef", "summary", "text", none)
    return {"topics": topics, "entries": entries, "index": index, "passages": passages}


def _cited(graph: Graph, rows: DataFrame, column: str, verses: DataFrame, phase: str) -> DataFrame:
    """rows with dst_id and targetEndVerseId for each citation in a column that names a verse; the rest are rejects."""
    refs, errors = explode_references(rows, F.col(column), graph.keep)
    graph.reject(errors, phase, "citation", F.col("error"))
    keyed = verses.select(F.col("volume").alias("kv"), F.col("slug").alias("ks"), F.col("chapter").alias("kc"), F.col("number").alias("kn"), F.col("id").alias("kid"))
    on = (F.col("volume") == F.col("kv")) & (F.col("slug") == F.col("ks")) & (F.col("chapter") == F.col("kc")) & (F.col("verse") == F.col("kn"))
    found, missed = lookup(refs, keyed, on, "kid", "dst_id")
    graph.reject(missed, phase, "verse not found", F.format_string("%s/%s %d:%d", "volume", "slug", "chapter", "verse"))
    return with_range_end(found, verses)


def load_footnotes(graph: Graph, notes: DataFrame, verses: DataFrame, studies: dict[str, DataFrame]) -> None:
    have = sorted_side(verses.select(F.col("id").alias("have")))
    graph.reject(notes.join(have, F.col("verse_id") == F.col("have"), "left_anti"), "footnotes", "verse not found", F.col("verse_id"))
    notes = notes.join(have, F.col("verse_id") == F.col("have"), "left_semi").select(F.col("verse_id").alias("src_id"), "kind", "key", "note_text", "reference_text", F.col("category"))
    cited = notes.where("kind = 'cross-ref'").withColumn("part", text.cross_reference_part(F.col("note_text")))
    cited = _cited(graph, cited, "part", verses, "footnotes")
    cited = first_of_pairs(cited, ["key", "ref_pos"])
    graph.edges["CROSS_REF"] = cited.select("src_id", "dst_id", F.lit("cross-ref").alias("category"), F.col("key").alias("footnoteMarker"), F.col("reference_text").alias("referenceText"), "targetEndVerseId")

    def by_name(kind: str, names: Column, label: str, phase: str) -> DataFrame:
        rows = notes.where(F.col("kind") == kind).select("*", F.posexplode(names).alias("nth", "wanted"))
        nodes = graph.nodes[label].select(F.col("name").alias("node_name"), F.col("id").alias("node_id"))
        found, missed = lookup(rows, nodes, F.col("wanted") == F.col("node_name"), "node_id", "dst_id")
        graph.reject(missed, "footnotes", phase, F.col("wanted"))
        return first_of_pairs(found, ["key", "nth"])

    topic = by_name("tg", text.topics(F.col("note_text")), "TopicalGuideEntry", "topic not found")
    graph.edges["TG_FOOTNOTE"] = topic.select("src_id", "dst_id", F.col("key").alias("footnoteMarker"), F.col("wanted").alias("tgTopicText"), F.col("reference_text").alias("referenceText"))
    entry = by_name("bd", F.filter(F.array(text.dictionary_entry(F.col("note_text"))), lambda x: x != ""), "BibleDictEntry", "dictionary entry not found")
    graph.edges["BD_FOOTNOTE"] = entry.select("src_id", "dst_id", F.col("key").alias("footnoteMarker"))
    jst = notes.where("kind = 'jst'").withColumn("part", text.translation_reference(F.col("note_text")))
    refs, errors = explode_references(jst, F.col("part"))
    graph.reject(errors, "footnotes", "citation", F.col("error"))
    passages = studies["passages"].where("slug <> ''").select(F.col("slug").alias("ps"), F.col("chapter").alias("pc"), F.col("id").alias("pid"), F.struct("pos", "nth").alias("place"))
    refs = refs.where("ref_pos = 0")
    found = first_match(refs, passages, (F.col("slug") == F.col("ps")) & (F.col("chapter").cast("string") == F.col("pc")), ["src_id", "key"], "place", "pid", "dst_id")
    graph.edges["JST_FOOTNOTE"] = first_of_pairs(found, ["key"]).select("src_id", "dst_id", F.col("key").alias("footnoteMarker"))


def load_references(graph: Graph, verses: DataFrame, studies: dict[str, DataFrame]) -> None:
    topic_nodes, entry_nodes, index_nodes = (graph.nodes[n].select(F.col("name").alias("node_name"), F.col("id").alias("node_id")) for n in ("TopicalGuideEntry", "BibleDictEntry", "IndexEntry"))

    def lines(rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("src_id"), "pos", F.posexplode("value").alias("nth", "e")).select("src_id", "pos", "nth", "e.phrase", F.coalesce("e.reference", F.lit("")).alias("reference"), F.col("e.key").alias("target"))

    def pairs(rows: DataFrame, kind: str, nodes: DataFrame, what: str) -> DataFrame:
        found, missed = lookup(rows.where(F.col("reference") == kind), nodes, F.col("target") == F.col("node_name"), "node_id", "dst_id")
        graph.reject(missed, "references", what, F.col("target"))
        return found.select("src_id", "dst_id")

    def to_verses(rows: DataFrame, kinds: list[str]) -> DataFrame:
        cited = _cited(graph, rows.where(~F.col("reference").isin(kinds)), "reference", verses, "references")
        return first_of_pairs(cited, ["pos", "nth", "ref_pos"]).select("src_id", "dst_id", "phrase")

    topics, index = lines(studies["topics"], ids.topic_id("name")), lines(studies["index"], ids.index_id("name"))
    graph.edges["TG_SEE_ALSO"] = pairs(topics, "TG", topic_nodes, "topic not found")
    graph.edges["TG_BD_REF"] = pairs(topics, "BD", entry_nodes, "dictionary entry not found")
    graph.edges["TG_VERSE_REF"] = to_verses(topics, ["TG", "BD"])
    graph.edges["IDX_SEE_ALSO"] = pairs(index, "IDX", index_nodes, "index entry not found")
    graph.edges["IDX_TG_REF"] = pairs(index, "TG", topic_nodes, "topic not found")
    graph.edges["IDX_BD_REF"] = pairs(index, "BD", entry_nodes, "dictionary entry not found")
    graph.edges["IDX_VERSE_REF"] = to_verses(index, ["IDX", "TG", "BD"])
    entries = studies["entries"].select(ids.dictionary_id("name").alias("src_id"), "pos", F.posexplode("value.references").alias("nth", "reference"))
    graph.edges["BD_VERSE_REF"] = first_of_pairs(_cited(graph, entries, "reference", verses, "references"), ["nth", "ref_pos"]).select("src_id", "dst_id", "targetEndVerseId")
    graph.edges["BD_SEE_ALSO"] = graph.edges["TG_SEE_ALSO"].limit(0)
    compared = studies["passages"].where("slug <> '' and coalesce(compareRef, '') <> ''").select(F.col("id").alias("src_id"), "compareRef")
    refs, errors = explode_references(compared, F.col("compareRef"))
    graph.reject(errors, "references", "citation", F.col("error"))
    keyed = verses.select(F.col("volume").alias("kv"), F.col("slug").alias("ks"), F.col("chapter").alias("kc"), F.col("number").alias("kn"), F.col("id").alias("kid"))
    each = expand_range(refs, "verse", "end_verse", "each")
    on = (F.col("volume") == F.col("kv")) & (F.col("slug") == F.col("ks")) & (F.col("chapter") == F.col("kc")) & (F.col("each") == F.col("kn"))
    found, missed = lookup(each, keyed, on, "kid", "dst_id")
    graph.reject(missed.where("each = verse"), "references", "compared verse not found", F.format_string("%s/%s %d:%d", "volume", "slug", "chapter", "verse"))
    graph.edges["COMPARES"] = found.select("src_id", "dst_id")


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again, so that they aren't made anew for each use."""
    at = fresh_folder(rows.sparkSession, "kept")
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def load_tables(chapters: DataFrame, sources: dict[str, DataFrame], every: bool = False) -> Graph:
    """All nodes and edges of source rows (those of read_chapters and read_studies); lazily, so a table that isn't used costs nothing. every: all
    tables will be used, so chapters, verses, footnotes and parsed citations, of which most are made, are written first."""
    graph = Graph(keep=written) if every else Graph()
    chapters = graph.keep(chapters)
    verses, notes = load_scriptures(graph, chapters)
    studies = load_studies(graph, sources)
    load_footnotes(graph, notes, verses, studies)
    load_references(graph, verses, studies)
    load_groups(graph, verses)
    return graph


def load(spark: SparkSession, scriptures: str, studies: str) -> Graph:
    """The graph of a source tree."""
    return load_tables(corpus.read_chapters(spark, scriptures), read_studies(spark, studies))


def write_graph(graph: Graph, root: str) -> None:
    """A full reload: every table is written anew, as <root>/nodes/<label> and <root>/edges/<type>, and the rejects."""
    for folder, tables in (("nodes", graph.nodes), ("edges", graph.edges), ("", {"rejects": graph.all_rejects()})):
        for name, table in tables.items():
            table.write.mode("overwrite").parquet("/".join(filter(None, (root, folder, name))))


def read_graph(spark: SparkSession, root: str, nodes: list[str], edges: list[str]) -> Graph:
    """The named tables of a written graph."""
    return Graph({k: spark.read.parquet(f"{root}/nodes/{k}") for k in nodes}, {k: spark.read.parquet(f"{root}/edges/{k}") for k in edges})


def with_vectors(graph: Graph, label: str, embedded: DataFrame) -> DataFrame:
    """A label's nodes with the vectors of `embedded` (id, embedding, error: what embed returns); failed ones stay without."""
    field = schemas.VECTOR_FIELD[label]
    return update_from(graph.nodes[label], embedded.where("embedding is not null").select("id", F.col("embedding").alias(field)))


def search_edges(graph: Graph) -> DataFrame:
    """Edges in the form that expansion reads: src_type, src_id, rel, dst_type, dst_id."""
    ends = {r.type: (schemas.ENTITY_TYPE.get(r.source), schemas.ENTITY_TYPE.get(r.target)) for r in schemas.RELATIONSHIPS if r.type != "CONTAINS"}
    wanted = {"INCLUDES", "HAS_VERSE", "TG_VERSE_REF", "TG_SEE_ALSO", "TG_BD_REF", "BD_VERSE_REF", "BD_SEE_ALSO", "IDX_VERSE_REF", "IDX_SEE_ALSO", "IDX_TG_REF", "IDX_BD_REF", "COMPARES"}
    parts = [graph.edges[t].select(F.lit(ends[t][0]).alias("src_type"), "src_id", F.lit(t).alias("rel"), F.lit(ends[t][1]).alias("dst_type"), "dst_id") for t in sorted(wanted)]
    return reduce(DataFrame.unionByName, parts)  # expansion drops what is double, after it has met the few seeds
