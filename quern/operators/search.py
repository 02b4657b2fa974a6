"""Contextual search: exact nearest neighbours over several labels, one-hop expansion, deduplication, re-ranking, top-k.

Everything is keyed by query_id, so many queries run as one plan. Only query vectors (a stated set) and seeds (at most
LIMIT for each query and label) are broadcast, both of a size that the caller sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import ENTITY_TYPE, METADATA, VECTOR, VECTOR_FIELD

PER_LABEL, PER_RELATION, PENALTY, BONUS, KNN = 10, 5, 0.05, 0.05, 20
#: Decimal places in which distances are compared.
PLACES = 9
#: Query vectors that meet the nodes at once.
QUERY_BLOCK = 4096
#: Distances that a task holds at once: a block of queries meets this many by its length nodes.
MET = 1 << 20

#: Entity type of the seed: (edge type, entity type reached).
EXPANSION = {
    "verse_group": [("INCLUDES", "verse")],
    "chapter": [("HAS_VERSE", "verse")],
    "topical_guide": [("TG_VERSE_REF", "verse"), ("TG_SEE_ALSO", "topical_guide"), ("TG_BD_REF", "bible_dict")],
    "bible_dict": [("BD_VERSE_REF", "verse"), ("BD_SEE_ALSO", "bible_dict")],
    "index": [("IDX_VERSE_REF", "verse"), ("IDX_SEE_ALSO", "index"), ("IDX_TG_REF", "topical_guide"), ("IDX_BD_REF", "bible_dict")],
    "jst_passage": [("COMPARES", "verse")],
}


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when either is null or has no length; vectors of different lengths are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    checked = F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")))
    size = norm(a) * norm(b)
    return F.when(a.isNotNull() & b.isNotNull() & (size > 0), 1 - checked / size)


def nearest(nodes: DataFrame, vector: list[float], k: int = PER_LABEL, key: str = "id", field: str = "embedding") -> DataFrame:
    """The k nodes nearest to one vector, with their distance; nodes without a vector are left out."""
    if not vector:
        raise ValueError("the query vector is empty")
    if k <= 0:
        raise ValueError("k must be positive")
    query = F.array(*(F.lit(float(x)) for x in vector))
    found = nodes.withColumn("distance", cosine_distance(F.col(field), query)).where("distance is not null")
    return found.orderBy("distance", key).limit(k)


def arrow_kind(kind: str) -> str:
    """The type in which Python numbers come back from a task; columns are cast to their own type afterwards."""
    return "bigint" if kind in ("tinyint", "smallint", "int") else kind


def nearest_by_group(nodes: DataFrame, queries: DataFrame, k: int = PER_LABEL, group: str = "label", key: str = "id", field: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, group, key, distance of the k nearest nodes for each query and group.

    queries (query_id, vector) is a stated set; it is met in blocks of `block` vectors, each broadcast as a matrix. A task
    multiplies its nodes with the matrix and passes on its own k best for each query and group, so what is shuffled is
    tasks x queries x groups x k rows, not nodes x queries.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = nodes.sparkSession
    kinds = dict(nodes.dtypes)
    given = {"query_id": dict(queries.dtypes)["query_id"], group: kinds[group], key: kinds[key]}
    schema = ", ".join(f"`{c}` {arrow_kind(t)}" for c, t in given.items()) + ", distance double"
    narrow = nodes.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(field).alias("vec")).where("vec is not null")

    def matcher(shared):
        def run(source):
            ids, matrix = shared.value
            best: dict = {}
            for batch in (b.slice(at, step) for b in source for step in [max(1, MET // max(1, len(matrix)))] for at in range(0, b.num_rows, step)):
                rows = batch.column("vec")
                width = matrix.shape[1]
                sizes = np.diff(np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1])
                if (sizes != width).any():
                    raise ValueError("vectors of different lengths")
                data = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
                length = np.sqrt((data * data).sum(axis=1))
                keys, groups = np.array(batch.column("key").to_pylist(), object), np.array(batch.column("grp").to_pylist(), object)
                real = length > 0
                data, keys, groups = data[real] / length[real, None], keys[real], groups[real]
                for g in set(groups.tolist()):
                    own = keys[groups == g]
                    distance = 1 - matrix @ data[groups == g].T
                    last = np.partition(distance, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
                    rows, columns = np.nonzero(distance <= last[:, None])  # the k nearest of each query, and ties
                    met: dict = {}
                    for q, x, d in zip(rows.tolist(), own[columns].tolist(), distance[rows, columns].tolist(), strict=True):
                        met.setdefault(q, []).append((d, x))
                    for q, found in met.items():
                        best[q, g] = sorted(best.get((q, g), []) + found)[:k]
            if best:
                out = [(ids[q], g, x, d) for (q, g), held in best.items() for d, x in held]
                yield pa.RecordBatch.from_pylist([{"query_id": a, group: b, key: c, "distance": d} for a, b, c, d in out])

        return run

    parts, held = [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        held.append((r["query_id"], np.asarray(r["vector"], np.float64)))
        if len(held) == block:
            parts.append(held)
            held = []
    if held:
        parts.append(held)
    out = None
    for p in parts:
        matrix = np.stack([v for _, v in p])
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        good = length[:, 0] > 0
        shared = spark.sparkContext.broadcast(([i for (i, _), g in zip(p, good, strict=True) if g], (matrix[good] / length[good])))
        part = narrow.mapInArrow(matcher(shared), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    out = out.select(*(F.col(c).cast(t).alias(c) for c, t in given.items()), "distance")
    order = Window.partitionBy("query_id", group).orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def metadata(**given: Column) -> Column:
    """The metadata struct with the given fields; the others are null."""
    fields = [f.split(":") for f in METADATA[len("struct<") : -1].split(",")]
    return F.struct(*((given[n].cast(t) if n in given else F.lit(None).cast(t)).alias(n) for n, t in fields))


def nearest_many(nodes: DataFrame, queries: DataFrame, k: int = PER_LABEL, key: str = "id", field: str = "embedding") -> DataFrame:
    """query_id, key, distance: what `nearest` finds for each of the stated queries, in one scan of the nodes."""
    return nearest_by_group(nodes.select(F.lit(0).alias("quern_group"), key, field), queries, k, "quern_group", key, field).drop("quern_group")


def stage_one(nodes: dict[str, DataFrame], vector: list[float], limit: int = PER_LABEL) -> DataFrame:
    """entity_type, id, name, text, distance, metadata: the nearest of each label. nodes: entity type to a frame with id,
    name, text, metadata and embedding."""
    parts = [nearest(df, vector, limit).select(F.lit(kind).alias("entity_type"), "id", "name", "text", "distance", "metadata") for kind, df in nodes.items()]
    return reduce(DataFrame.unionByName, parts)


def stage_one_many(nodes: dict[str, DataFrame], queries: DataFrame, limit: int = PER_LABEL) -> DataFrame:
    """query_id and the columns of stage_one for each of the stated queries; each label is scanned once for all of them, and once for the rows found."""
    known = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("entity_type"), "id", "name", "text", "metadata", "embedding") for kind, df in nodes.items()])
    best = nearest_by_group(known, queries, limit, "entity_type").withColumnsRenamed({"entity_type": "of_type", "id": "of_id"})
    found = known.drop("embedding").join(best, (F.col("entity_type") == F.col("of_type")) & (F.col("id") == F.col("of_id")))
    return found.select("query_id", "entity_type", "id", "name", "text", "distance", "metadata")


def leads_to(source: Column, relation: Column, expansion: dict[str, list[tuple[str, str]]] = EXPANSION) -> Column:
    """The entity type that an edge type leads to from a seed's entity type; null where expansion doesn't follow it."""
    pairs = [(k, rel, to) for k, follows in expansion.items() for rel, to in follows]
    return reduce(lambda otherwise, p: F.when((source == p[0]) & (relation == p[1]), p[2]).otherwise(otherwise), pairs, F.lit(None).cast("string"))


def expand(seeds: DataFrame, edges: DataFrame, limit: int = PER_RELATION, expansion: dict[str, list[tuple[str, str]]] = EXPANSION) -> DataFrame:
    """Neighbours of seeds by the edge types that their entity type follows. seeds: query_id, entity_type, id, distance; edges:
    src_id, rel, dst_id and src_type, as an edge type may start at several. At most `limit` for each seed and relationship,
    by dst_id. Returns query_id, entity_type, id, distance (the seed's and PENALTY more) and the seed."""
    s = seeds.select("query_id", F.col("entity_type").alias("seed_type"), F.col("id").alias("seed_id"), F.col("distance").alias("seed_distance"))
    followed = edges.withColumn("reached", leads_to(F.col("src_type"), F.col("rel"), expansion)).where("reached is not null")
    met = followed.join(s, (F.col("src_type") == F.col("seed_type")) & (F.col("src_id") == F.col("seed_id")))
    met = met.dropDuplicates(["query_id", "seed_type", "seed_id", "rel", "dst_id"])  # several edges may join the same two nodes
    order = Window.partitionBy("query_id", "seed_type", "seed_id", "rel").orderBy("dst_id")
    met = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    return met.select("query_id", F.col("reached").alias("entity_type"), F.col("dst_id").alias("id"), (F.col("seed_distance") + PENALTY).alias("distance"), "seed_type", "seed_id")


def new_neighbours(stage1: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Neighbours that aren't hits already, each once, with the smallest distance."""
    order = Window.partitionBy("query_id", "entity_type", "id").orderBy(in_places("distance"), "seed_type", "seed_id")
    once = neighbours.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return once.join(stage1.select("query_id", "entity_type", "id"), ["query_id", "entity_type", "id"], "left_anti")


def in_places(distance: Column | str, places: int = PLACES) -> Column:
    """A distance as it is compared: in so many places that ties don't rest on the last bit of a sum."""
    return F.round(distance, places) + F.lit(0.0)


def rank_score() -> Column:
    return in_places(F.when(F.col("entity_type") == "verse", F.col("distance") - BONUS).otherwise(F.col("distance")))


def ranked(stage1: DataFrame, stage2: DataFrame, k: int = KNN) -> DataFrame:
    """The k best for each query: verses are ranked as if BONUS nearer; first-stage hits win ties."""
    if k <= 0:
        raise ValueError("k must be positive")
    columns = ["query_id", "entity_type", "id", "distance"]
    both = stage1.select(*columns, F.lit(1).alias("stage")).unionByName(stage2.select(*columns, F.lit(2).alias("stage")))
    both = both.withColumn("score", rank_score())
    order = Window.partitionBy("query_id").orderBy("score", "stage", in_places("distance"), "entity_type", "id")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).drop("score")


def contextual_search(stage1: DataFrame, edges: DataFrame, k: int = KNN, expansion: dict[str, list[tuple[str, str]]] = EXPANSION) -> DataFrame:
    """stage1: query_id, entity_type, id, distance of the hits of each label."""
    return ranked(stage1, new_neighbours(stage1, expand(stage1, edges, expansion=expansion)), k)


def result_nodes(nodes: dict[str, DataFrame]) -> DataFrame:
    """entity_type, id, name, text, metadata and embedding of every label that a search may return. nodes: label to its table."""
    c = F.col
    shown = {
        "VerseGroup": (F.lit(""), c("text"), metadata(startVerseNumber=c("startVerseNumber"), endVerseNumber=c("endVerseNumber"), chapterID=chapter_of_group(c("id")))),
        "Chapter": (F.lit(""), c("summary"), metadata(chapterNumber=c("number"), url=c("url"))),
        "TopicalGuideEntry": (c("name"), F.lit(""), metadata()),
        "BibleDictEntry": (c("name"), c("text"), metadata()),
        "IndexEntry": (c("name"), F.lit(""), metadata()),
        "JSTPassage": (F.lit(""), c("text"), metadata(book=c("book"), chapter=c("chapter"), comprises=c("comprises"), compareRef=c("compareRef"), summary=c("summary"))),
        "Verse": (c("reference"), c("text"), metadata(verseNumber=c("number"), reference=c("reference"))),
    }
    parts = []
    for label, (name, text, more) in shown.items():
        if label in nodes:
            vector = c(VECTOR_FIELD[label]) if label in VECTOR_FIELD else F.lit(None).cast(VECTOR)
            empty = F.lit("")
            parts.append(nodes[label].select(F.lit(ENTITY_TYPE[label]).alias("entity_type"), "id", F.coalesce(name, empty).alias("name"), F.coalesce(text, empty).alias("text"), more.alias("metadata"), vector.alias("embedding")))
    return reduce(DataFrame.unionByName, parts)


def chapter_of_group(group: Column) -> Column:
    """The chapter's id, from that of one of its verse groups."""
    return F.regexp_replace(group, "^vg/(.*)/[^/]*$", "ch/$1")


def search(nodes: dict[str, DataFrame], edges: DataFrame, query: str, embedder, knn: int = KNN, per_label: int = PER_LABEL) -> DataFrame:
    """The whole search for one text: SEARCH_RESULT columns and position, nearest first. nodes: label to its table; edges: those
    of load.search_edges; the embedder gets one text, on the driver."""
    if not query:
        raise ValueError("the search query is empty")
    if knn <= 0:
        raise ValueError("knn must be positive")
    vector = embedder.embed_batch([query])[0]
    known = result_nodes(nodes)
    hits = [nearest(known.where(F.col("entity_type") == ENTITY_TYPE[label]), list(vector), per_label) for label in VECTOR_FIELD if label in nodes]
    stage1 = reduce(DataFrame.unionByName, hits).select(F.lit(0).alias("query_id"), "entity_type", "id", "distance")
    best = contextual_search(stage1, edges, knn).select(F.col("entity_type").alias("of_type"), F.col("id").alias("of_id"), "distance", "position")  # at most knn rows
    full = known.join(F.broadcast(best), (F.col("entity_type") == F.col("of_type")) & (F.col("id") == F.col("of_id")))
    return full.select("entity_type", "id", "name", "text", "distance", "metadata", "position").orderBy("position")


def sort_by_distance(results: DataFrame) -> DataFrame:
    return results.orderBy("distance", "entity_type", "id")


def printable(results: DataFrame) -> Column:
    return F.format_string("(%.3f) %s [%s]: %s", "distance", "entity_type", "id", F.coalesce("text", F.lit("")))
