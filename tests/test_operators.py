import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import chat, embeddings, mutations, predicates, search, windows
from quern.operators.paging import Connection, decode_cursor
from quern.sources import schemas


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def lit(spark, function, s, *more):
    return value(spark, function(F.col("s"), *more), s=s)


def hits(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, entity_type string, id string, distance double")


def test_verse_bonus_lets_a_topic_lead(spark):
    got = search.ranked(hits(spark, [("verse_group", "g", 0.32), ("topical_guide", "t", 0.30)]), hits(spark, [("verse", "v", 0.35)])).orderBy("position").collect()
    assert [(r.id, r.distance) for r in got][-1] == ("g", 0.32) and len(got) == 3


def test_distant_verse_stays_behind(spark):
    got = search.ranked(hits(spark, [("verse_group", "g", 0.10)]), hits(spark, [("verse", "v", 0.50)])).orderBy("position").collect()
    assert [r.id for r in got] == ["g", "v"]


def test_first_stage_wins_and_smaller_distance_is_kept(spark):
    s1 = hits(spark, [("verse", "a", 0.4)])
    near = hits(spark, [("verse", "a", 0.1), ("verse", "b", 0.2), ("verse", "b", 0.15)]).select("*", F.lit("x").alias("seed_type"), F.lit("y").alias("seed_id"))
    assert [(r.id, r.distance) for r in search.new_neighbours(s1, near).collect()] == [("b", 0.15)]
    assert search.new_neighbours(s1, near.limit(0)).count() == 0


def test_expansion_adds_the_penalty_and_stops_at_five(spark):
    edges = spark.createDataFrame([("verse_group", "g", "INCLUDES", "verse", f"v{i}") for i in range(9)], "src_type string, src_id string, rel string, dst_type string, dst_id string")
    got = search.expand(hits(spark, [("verse_group", "g", 0.2), ("verse", "v1", 0.1)]), edges).collect()
    assert sorted(r.id for r in got) == ["v0", "v1", "v2", "v3", "v4"] and all(abs(r.distance - 0.25) < 1e-12 for r in got)


def test_expansion_follows_only_the_edge_types_of_the_seed(spark):
    edges = spark.createDataFrame([("topical_guide", "t", r, f"x{i}") for i, r in enumerate(["TG_VERSE_REF", "TG_SEE_ALSO", "TG_BD_REF", "IDX_TG_REF", "CROSS_REF"])] + [("verse", "v", "CROSS_REF", "w")], "src_type string, src_id string, rel string, dst_id string")
    got = search.expand(hits(spark, [("topical_guide", "t", 0.2), ("verse", "v", 0.1)]), edges).collect()
    assert {(r.entity_type, r.id) for r in got} == {("verse", "x0"), ("topical_guide", "x1"), ("bible_dict", "x2")}


class FixedEmbedder:
    def embed_batch(self, texts):
        return [[1.0, 0.0] for _ in texts]


def test_one_search_call_returns_full_results(spark):
    vector = "array<float>"
    nodes = {
        "VerseGroup": spark.createDataFrame([("vg/ot/gen/1/1-5", "group text", 1, 5, [1.0, 0.1]), ("vg/ot/gen/1/4-8", "far", 4, 8, None)], f"id string, text string, startVerseNumber int, endVerseNumber int, embedding {vector}"),
        "Chapter": spark.createDataFrame([("ch/ot/gen/1", 1, "summary", [0.0, 1.0], "u")], f"id string, number int, summary string, summaryEmbedding {vector}, url string"),
        "TopicalGuideEntry": spark.createDataFrame([("tg/Faith", "Faith", [1.0, 0.5])], f"id string, name string, embedding {vector}"),
        "BibleDictEntry": spark.createDataFrame([("bd/Ark", "Ark", "a box", None)], f"id string, name string, text string, embedding {vector}"),
        "IndexEntry": spark.createDataFrame([], f"id string, name string, embedding {vector}"),
        "JSTPassage": spark.createDataFrame([("jst/gen/1/1", "Genesis", "1", "1", "Gen. 1:1", "sum", "jst text", [0.9, 0.9])], f"id string, book string, chapter string, comprises string, compareRef string, summary string, text string, embedding {vector}"),
        "Verse": spark.createDataFrame([("v/ot/gen/1/1", 1, "Gen. 1:1", "verse text"), ("v/ot/gen/1/2", 2, "Gen. 1:2", "second")], "id string, number int, reference string, text string"),
    }
    edges = spark.createDataFrame([("verse_group", "vg/ot/gen/1/1-5", "INCLUDES", "v/ot/gen/1/1"), ("verse_group", "vg/ot/gen/1/1-5", "INCLUDES", "v/ot/gen/1/2"), ("topical_guide", "tg/Faith", "TG_BD_REF", "bd/Ark")], "src_type string, src_id string, rel string, dst_id string")
    got = search.search(nodes, edges, "what is faith", FixedEmbedder()).collect()
    # the verses' distance is the group's and the penalty, less the bonus of a verse when ranked: a tie, which the first stage wins
    assert [(r.entity_type, r.id) for r in got[:4]] == [("verse_group", "vg/ot/gen/1/1-5"), ("verse", "v/ot/gen/1/1"), ("verse", "v/ot/gen/1/2"), ("topical_guide", "tg/Faith")]
    assert [(r.entity_type, r.name, r.text) for r in got[4:]] == [("bible_dict", "Ark", "a box"), ("jst_passage", "", "jst text"), ("chapter", "", "summary")]
    by_id = {r.id: r for r in got}
    assert by_id["vg/ot/gen/1/1-5"].metadata.chapterID == "ch/ot/gen/1" and by_id["vg/ot/gen/1/1-5"].metadata.endVerseNumber == 5
    assert by_id["v/ot/gen/1/2"].name == "Gen. 1:2" and by_id["v/ot/gen/1/2"].metadata.verseNumber == 2 and by_id["jst/gen/1/1"].metadata.compareRef == "Gen. 1:1"
    assert len(search.search(nodes, edges, "q", FixedEmbedder(), knn=2).collect()) == 2
    assert search.search(nodes, edges, "q", FixedEmbedder()).drop("position").dtypes == spark.createDataFrame([], schemas.SEARCH_RESULT).dtypes
    for query, knn in (("", 5), ("q", 0)):
        with pytest.raises(ValueError):
            search.search(nodes, edges, query, FixedEmbedder(), knn)


def test_nearest_orders_and_skips_nodes_without_vector(spark):
    rows = [("v1", [1.0, 0.0, 0.0]), ("v2", [0.9, 0.1, 0.0]), ("v3", [0.0, 1.0, 0.0]), ("v4", None), ("v5", [0.0, 0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = search.nearest(nodes, [1.0, 0.0, 0.0], 10).collect()
    assert [r.id for r in got] == ["v1", "v2", "v3"] and abs(got[0].distance) < 1e-6
    many = search.nearest_by_group(nodes.withColumn("label", F.lit("x")), spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0])], "query_id long, vector array<float>"), 2).collect()
    assert {(r.query_id, r.id) for r in many} == {(7, "v1"), (7, "v2"), (8, "v3"), (8, "v2")}
    assert search.nearest_by_group(nodes.withColumn("label", F.lit("x")), spark.createDataFrame([], "query_id long, vector array<float>")).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        search.nearest(nodes, [1.0, 0.0], 3).collect()
    for vector, k in (([], 1), ([1.0], 0)):
        with pytest.raises(ValueError):
            search.nearest(nodes, vector, k)


def test_equal_vectors_are_cut_at_k(spark):
    nodes = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(5)], "id long, embedding array<float>, label string").repartition(3)
    q = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, vector array<float>")
    assert sorted(r.id for r in search.nearest_by_group(nodes, q, 2).collect()) == [0, 1]


@pytest.mark.parametrize("n,want", [(1, ["1-1"]), (5, ["1-5"]), (6, ["1-5", "4-6"]), (8, ["1-5", "4-8"]), (9, ["1-5", "4-8", "7-9"]), (31, None)])
def test_sliding_groups(spark, n, want):
    rows = spark.createDataFrame([("c", i, f"t{i}") for i in range(1, n + 1)], "ch string, number int, text string")
    got = sorted(windows.sliding_groups(rows, ["ch"], "number", "text").collect(), key=lambda r: r["first"])
    said = [f"{r['first']}-{r['last']}" for r in got]
    assert said == want if want else (len(said), said[-1]) == (10, "28-31")
    assert got[0]["text"].startswith("t1")


def label(spark):
    people = spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, None, 50), (4, "Zoë", 30)], "id int, name string, age int")
    pets = spark.createDataFrame([(10, 1, "cat"), (11, 1, "dog"), (12, 3, "dog")], "pid int, owner int, kind string")
    owner = predicates.Label(people)
    pet = predicates.Label(pets, "pid")
    owner.links["pets"] = predicates.Link(pets.select("owner", F.col("pid").alias("far")), "owner", "far", pet)
    pet.links["owner"] = predicates.Link(pets.select(F.col("pid").alias("near"), "owner"), "near", "owner", owner)
    return owner


@pytest.mark.parametrize(
    "where,ids",
    [
        ({}, [1, 2, 3, 4]), ({"AND": []}, [1, 2, 3, 4]), ({"OR": []}, []), ({"age_not": 30}, [3]), ({"age_nin": [50]}, [1, 4]), ({"age_in": []}, []),
        ({"name_regex": "A"}, []), ({"name_regex": "A.*"}, [1]), ({"age_isNull": True}, [2]), ({"NOT": {"age": 30}}, [3]), ({"pets_some": {}}, [1, 3]),
        ({"pets_some": {"kind": "cat", "owner": {"age_gte": 30}}}, [1]), ({"NOT": {"pets_some": {"kind": "dog"}}}, [2, 4]), ({"OR": [{"pets_some": {"kind": "cat"}}, {"name_startsWith": "Z"}]}, [1, 4]),
    ],
)
def test_predicates(spark, where, ids):
    assert sorted(r.id for r in predicates.filtered(label(spark), where).collect()) == ids


def test_unknown_fields_are_errors(spark):
    with pytest.raises(ValueError):
        predicates.filtered(label(spark), {"nope": 1})
    with pytest.raises(ValueError):
        predicates.filtered(label(spark), {"age_contains": "3"})


def test_pages_follow_each_other(spark):
    seen, after = [], None
    for _ in range(5):
        c = Connection(label(spark), 1, after, None, [{"age": "DESC"}, {"name": "ASC"}])
        edges, info = c.edges()
        seen += [e["node"]["id"] for e in edges]
        assert info["hasPreviousPage"] == (after is not None) and c.total_count() == 4
        after = info["endCursor"]
        if not info["hasNextPage"]:
            break
    assert seen == [2, 3, 1, 4]
    with pytest.raises(ValueError):
        decode_cursor("%%%")


def test_mutations(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    edges = spark.createDataFrame([("a", "b", "x")], "src_id string, dst_id string, note string")
    assert mutations.create(nodes, spark.createDataFrame([("c",)], "id string")).count() == 3
    merged = mutations.merge(nodes, spark.createDataFrame([("b", 9), ("c", 5)], "id string, n int"), ["id"], {"n": F.col("in.n")}, {"n": F.col("in.n") * 10})
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1), ("b", 90), ("c", 5)]
    assert sorted(tuple(r) for r in mutations.update_from(nodes, spark.createDataFrame([("b", 7)], "id string, n int")).collect()) == [("a", 1), ("b", 7)]
    left, kept, counts = mutations.delete(nodes, nodes.where("id = 'b'"), {"E": (edges, True, True)})
    assert left.count() == 1 and kept["E"].count() == 0 and tuple(counts.first()) == (1, 1)
    new = spark.createDataFrame([("a", "zz", None), ("a", "b", "y")], edges.schema)
    made, _, stubs = mutations.connect_rows(edges, new, nodes, nodes, "stub")
    assert made.count() == 3 and [r.id for r in stubs.collect()] == ["zz"]
    made, _, stubs = mutations.connect_rows(edges, new, nodes, nodes)
    assert made.count() == 2 and stubs.count() == 0
    assert mutations.disconnect(edges, edges).count() == 0
    assert mutations.edges_of_lists(spark.createDataFrame([("p", ["x", "y"])], "id string, kids array<string>"), "id", "kids").count() == 2


def test_text_functions(spark):
    assert lit(spark, text.normalize_whitespace, " a  b c\n") == "a b c"
    assert tuple(lit(spark, text.footnote_key, "12b")) == (12, "b") and tuple(lit(spark, text.footnote_key, "x")) == (0, "")
    assert lit(spark, text.cross_reference_part, "Gen. 1:1; 2:3. TG Faith.") == "Gen. 1:1; 2:3" and lit(spark, text.cross_reference_part, "TG Faith") == ""
    assert lit(spark, text.topics, "Ex. 1:1. TG Faith; Hope in God. BD Ark.") == ["Faith", "Hope in God"]
    assert lit(spark, text.dictionary_entry, "BD Ark of the Covenant. More.") == "Ark of the Covenant" and lit(spark, text.dictionary_entry, "none") == ""
    assert lit(spark, text.translation_reference, "JST Gen. 15:9–12 (Appendix).") == "Gen. 15:9–12"
    assert lit(spark, text.split_composite, "Ex. 4:10–16, 27–31") == ["Ex. 4:10–16", "Ex. 4:27–31"] and lit(spark, text.split_composite, "Ex. 4") == ["Ex. 4"]
    lines = [("", "1 Ne. 3:7", ""), ("", "4:1", ""), ("", "TG", "Hope"), ("", "4:2", ""), ("", "D&C 5:1", ""), ("", "9–10", "")]
    carried = value(spark, text.carry_book_prefix(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("phrase", "reference", "key"), x))) for x in lines))))
    assert [e.reference for e in carried] == ["1 Ne. 3:7", "1 Ne. 4:1", "TG", "1 Ne. 4:2", "D&C 5:1", "D&C 9–10"]
    assert tuple(lit(spark, text.year_month, "2024/4")) == (2024, 4) and lit(spark, text.year_month, "2024") is None
    assert value(spark, text.latest_conference(F.lit("2026-03-31").cast("date"))) == "2025-10"
    assert [tuple(g) for g in value(spark, text.conference_grid((2020, 5), (2021, 4)))] == [(2020, 10), (2021, 4)]
    assert [value(spark, text.relevance_percent(F.lit(x))) for x in (-1.0, 0.0, 0.155, 1.0, 2.0)] == [100, 100, 85, 0, 0]
    assert tuple(lit(spark, text.host_and_port, "redis://u:p@h:99/x")) == ("h", 99) and tuple(lit(spark, text.host_and_port, "h")) == ("h", 6379)
    assert lit(spark, text.talk_slug, "/study/general-conference/2024/04/11nelson?lang=eng") == "11nelson"
    assert lit(spark, text.cache_path, "https://h/study/scriptures/ot/gen/1?lang=eng", "c") == "c/scriptures/ot/gen/1.html"
    assert tuple(value(spark, text.translation_heading(F.lit("JST, Genesis 9:4–6"), F.lit("9")))) == ("Genesis", "4-6")
    for said, want in (("JST, 1 Corinthians 7:1–2, 5.", ("1 Corinthians", "7:1-2, 5")), ("JST, Exodus 9:1–9:18", ("Exodus", "1-9:18")), ("JST, Matthew", ("Matthew", ""))):
        assert tuple(value(spark, text.translation_heading(F.lit(said), F.lit("9")))) == want
    assert lit(spark, text.sha256_hex, "")[:8] == "e3b0c442" and lit(spark, text.shortened, "x" * 301).endswith("x...")


def test_embedding_targets_and_retries(spark):
    class Fake:
        def embed_batch(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t)), 1.0] for t in texts]

    nodes = spark.createDataFrame([("a", "one", None), ("b", "", None), ("c", "two", [1.0]), ("d", "bad", None), ("e", "x" * 9, None)], "id string, text string, embedding array<float>")
    got = {r.id: r for r in embeddings.embed(embeddings.targets(nodes), Fake(), batch=10, most=5, concurrency=1).collect()}
    assert set(got) == {"a", "d", "e"} and got["a"].embedding == [3.0, 1.0] and got["e"].embedding == [5.0, 1.0] and got["d"].embedding is None and got["d"].error == "bad text"
    named = spark.createDataFrame([("a", "N", None), ("b", "", None)], "id string, name string, embedding array<float>")
    phrases = spark.createDataFrame([("a", i, f"p{i}") for i in range(30)] + [("b", 0, "q"), ("a", -1, "")], "src_id string, pos int, phrase string")
    made = {r.id: r.text for r in embeddings.named_targets(named, phrases).collect()}
    assert made["a"] == "N. " + "; ".join(f"p{i}" for i in range(20)) and made["b"] == "q"


class Echo:
    def __init__(self):
        self.sizes = []

    def complete(self, messages):
        self.sizes.append(len(messages))
        if messages[-1]["content"] == "fail":
            raise ValueError
        return {"role": "assistant", "content": "re: " + messages[-1]["content"]}


def test_chat_session():
    client = Echo()
    s = chat.Session(client, "be kind")
    for t in ("a", "b", "c"):
        s.send(t)
    assert client.sizes == [2, 4, 6] and len(s.history()) == 7
    with pytest.raises(ValueError):
        s.send("")
    with pytest.raises(ValueError):
        s.send("fail")
    assert s.history()[-1]["content"] == "fail" and s.pop_last()["content"] == "fail"
    s.reset()
    assert len(s.history()) == 1 and s.pop_last() is None


def test_history_of_a_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, r.n_sent) for r in windows.history(rows).collect()) == [(0, 1), (2, 3)]
