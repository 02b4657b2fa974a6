import json
import os

import pytest
from pyspark.sql import functions as F

from quern.plans import load
from quern.sources import corpus, pages, schemas


def write(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))

    def verses(n):
        return [{"number": i, "text": f"text {i}", "footnote_markers": []} for i in range(1, n + 1)]

    notes = {
        "1a": {"category": "cross-ref", "reference_text": "w", "text": "Ex. 2:3–4; Gen. 2:1. TG Faith."},
        "1b": {"category": "tg, bd", "reference_text": "", "text": "TG Faith; Missing. BD Ark."},
        "2a": {"category": "jst", "reference_text": "", "text": "JST Gen. 1:1–2 (x)."},
        "2b": {"category": "trn", "reference_text": "", "text": "HEB word"},
        "10a": {"category": "or", "reference_text": "", "text": "OR other"},
        "1c": {"category": "cross-ref", "reference_text": "", "text": "Ex. 2:3; Ex. 99:1; Foo 1"},
        "zz": {"category": "or", "reference_text": "", "text": "no verse"},
    }
    write(f"{root}/s/ot/gen/1.json", {"url": "u1", "book": "Genesis", "chapter": 1, "summary": "s", "verses": verses(6), "footnotes": notes})
    write(f"{root}/s/ot/gen/2.json", {"url": "", "book": "Genesis", "chapter": 2, "summary": "", "verses": [*verses(1), {"number": 0, "text": "odd", "footnote_markers": []}], "footnotes": {}})
    write(f"{root}/s/ot/ex/2.json", {"url": "", "book": "", "chapter": 2, "summary": "", "verses": verses(4), "footnotes": {}})
    write(f"{root}/h/topical-guide.json", {"Faith": [{"phrase": "p", "reference": "Gen. 1:1", "key": ""}, {"phrase": "q", "reference": "Gen. 1:1", "key": ""}, {"phrase": "", "reference": "TG", "key": "Hope"}, {"phrase": "", "reference": "BD", "key": "Ark"}, {"phrase": "", "reference": "TG", "key": "None"}], "Hope": []})
    write(f"{root}/h/bible-dictionary.json", {"Ark": {"text": "a box", "references": ["Ex. 2:1–2", "nonsense"]}})
    write(
        f"{root}/h/jst.json",
        [
            {"reference": "", "book": "Genesis", "chapter": "1", "entries": [{"comprises": "", "compare": "Gen. 1:2-4", "summary": "", "verses": [{"number": 1, "text": "a"}, {"number": 2, "text": "b"}]}, {"comprises": "9", "compare": "", "summary": "", "verses": []}]},
            {"reference": "", "book": "Nowhere", "chapter": "1", "entries": []},
        ],
    )
    return load.load(spark, f"{root}/s", f"{root}/h")


def pairs(graph, name):
    return sorted((r.src_id, r.dst_id) for r in graph.edges[name].collect())


def test_nodes(graph):
    counts = {r["name"]: r["rows"] for r in graph.counts().collect()}
    assert {k: counts[k] for k in schemas.NODES} == {"Volume": 5, "Book": 2, "Chapter": 3, "Verse": 11, "VerseGroup": 4, "TopicalGuideEntry": 2, "BibleDictEntry": 1, "IndexEntry": 0, "JSTPassage": 1}
    books = {r.id: r.name for r in graph.nodes["Book"].collect()}
    assert books == {"book/ot/gen": "Genesis", "book/ot/ex": "Ex."}
    verse = {r.id: r for r in graph.nodes["Verse"].collect()}
    assert verse["v/ot/gen/1/2"].reference == "Gen. 1:2" and json.loads(verse["v/ot/gen/1/2"].translationNotes) == [{"marker": "b", "hebrew_text": "HEB word"}]
    assert verse["v/ot/gen/1/1"].alternateReadings is None
    for label, frame in graph.nodes.items():
        assert frame.columns == [c.split()[0] for c in schemas.NODES[label].split(", ")]


def test_edges(graph):
    assert pairs(graph, "CROSS_REF") == [("v/ot/gen/1/1", "v/ot/ex/2/3"), ("v/ot/gen/1/1", "v/ot/gen/2/1")]
    assert {r.dst_id: r.targetEndVerseId for r in graph.edges["CROSS_REF"].collect()}["v/ot/ex/2/3"] == "v/ot/ex/2/4"
    assert pairs(graph, "TG_FOOTNOTE") == [("v/ot/gen/1/1", "tg/Faith")] and pairs(graph, "BD_FOOTNOTE") == [("v/ot/gen/1/1", "bd/Ark")]
    assert pairs(graph, "JST_FOOTNOTE") == [("v/ot/gen/1/2", "jst/gen/1/1-2")]
    assert pairs(graph, "TG_VERSE_REF") == [("tg/Faith", "v/ot/gen/1/1")] and graph.edges["TG_VERSE_REF"].first()["phrase"] == "p"
    assert pairs(graph, "TG_SEE_ALSO") == [("tg/Faith", "tg/Hope")] and pairs(graph, "TG_BD_REF") == [("tg/Faith", "bd/Ark")]
    assert pairs(graph, "BD_VERSE_REF") == [("bd/Ark", "v/ot/ex/2/1")]
    assert pairs(graph, "COMPARES") == [("jst/gen/1/1-2", f"v/ot/gen/1/{n}") for n in (2, 3, 4)]
    assert len(pairs(graph, "INCLUDES")) == 5 + 3 + 1 + 4 and len(pairs(graph, "CONTAINS")) == 5
    assert load.search_edges(graph).where("src_type = 'topical_guide'").count() == 3


def test_rejects(graph):
    kinds = {(r.kind, r.detail) for r in graph.all_rejects().collect()}
    for want in [("topic not found", "Missing"), ("topic not found", "None"), ("verse not found", "ot/ex 99:1"), ("unknown translation book", "Nowhere"), ("key without a verse", "zz"), ("citation", "cannot parse reference: nonsense")]:
        assert want in kinds
    assert any(k == "verse without a number" for k, _ in kinds) and any(k == "translation without text" for k, _ in kinds)


def test_missing_files_and_settings(spark, tmp_path):
    empty = load.load(spark, str(tmp_path), str(tmp_path))
    assert {r["name"]: r["rows"] for r in empty.counts().collect()}["Verse"] == 0
    with pytest.raises(ValueError):
        corpus.read_config({"ENV": "test"})
    assert corpus.read_config({"ENV": "production", "DATA_DIR": "d"})["DATA_DIR"] == "d"


def test_page_extraction(spark):
    html = {
        "chapter": '<h1><span class="dominant">Genesis</span> of</h1><p class="title-number">Chapter 3</p><p class="study-summary">Sum</p><p class="verse"><span class="verse-number">1 </span>In <span class="iconPointer-OKie_">no</span><a class="study-note-ref" href="#note1a"><sup class="marker" data-value="a">a</sup>the</a> day</p><footer><ul><li id="note1a" data-full-marker="1a"><span data-note-category="cross-ref"><a href="/study/scriptures/ot/ex/1">Ex. 1:1</a></span></li></ul></footer>',
        "dictionary": '<h1>Ark</h1><div class="body-block"><p>One <a class="scripture-ref" href="/study/scriptures/ot/gen/1">Gen. 1:1</a></p><p>Two <a class="scripture-ref" href="/study/scriptures/tg/x">X</a></p></div>',
        "entry": '<article><h1>Faith</h1><div class="body-block"><p class="title">See also <a class="scripture-ref" href="/study/scriptures/tg/hope">Hope</a>; <a class="scripture-ref" href="/study/scriptures/gs/x"><small>GS</small> Belief</a>; <a class="scripture-ref" href="/study/scriptures/bd/ark">Ark</a>; <a class="scripture-ref" href="/study/scriptures/nt/heb/11">Heb. 11:1</a></p><p class="entry">have faith, <a class="scripture-ref" href="/study/scriptures/ot/ex/20">Ex. 20:5</a> (<a class="scripture-ref" href="/x">34:7</a>; <a class="scripture-ref" href="/y">Deut. 5:9</a>).</p><p class="entry">more, <a class="scripture-ref" href="/z">21:2</a>.</p></div></article>',
        "index_entry": '<article><h1>Alma</h1><div class="body-block"><p class="title"><a class="scripture-ref" href="/study/scriptures/triple-index/amlici">Amlici</a> <a class="scripture-ref" href="/study/scriptures/tg/faith">Faith</a></p></div></article>',
        "translation": '<h1>JST</h1><article><section><header><h2><strong>JST, Genesis 1:1–2.</strong> Compare <a class="scripture-ref" href="/x">Genesis 1:1</a></h2><p class="study-intro">Intro</p></header><p class="verse"><span class="verse-number">1 </span>words<sup class="marker">a</sup></p></section><section><header><h2><strong>none</strong></h2></header></section></article>',
        "talk": '<h1>Title</h1><p class="author-name">By Some One</p><p class="author-role">Role</p><p id="p1">First<sup>1</sup> words</p><p>skip</p>',
        "sessions": '<ul><li data-content-type="general-conference-session"><a href="/study/general-conference/2024/04/morning-session"><p class="title">Morning</p></a><a href="/study/general-conference/2024/04/11talk?lang=eng"><span>A Talk</span><p>A Speaker</p></a><a href="/study/general-conference/2024/04/11talk?lang=eng">again</a><a href="/study/general-conference/2024/04/12talk"><p>Lone</p></a></li><li><a href="/study/general-conference/2024/04/13out">x</a></li></ul>',
    }
    df = spark.createDataFrame([(k, v) for k, v in html.items()], "page_id string, html string")
    got = {k: pages.extract(df.where(df.page_id == k), k).first()["content"] for k in html}
    c = got["chapter"]
    assert (c.book, c.chapter, c.summary, c.verses[0].number, c.verses[0].text, c.verses[0].footnote_markers) == ("Genesis", 3, "Sum", 1, "In the day", ["a"])
    assert (c.footnotes[0].key, c.footnotes[0].category, c.footnotes[0].reference_text, c.footnotes[0].references) == ("1a", "cross-ref", "the", ["Ex. 1:1"])
    assert got["dictionary"].text == "One Gen. 1:1\n\nTwo X" and got["dictionary"].references == ["Gen. 1:1"]
    assert got["entry"].title == "Faith"
    assert [tuple(e) for e in got["entry"].entries] == [("", "TG", "Hope"), ("", "GS", "Belief"), ("", "BD", "Ark"), ("", "Heb. 11:1", ""), ("have faith", "Ex. 20:5 (34:7; Deut. 5:9)", ""), ("more", "21:2", "")]
    carried = pages.entries(df.where("page_id = 'entry'")).first()
    assert [e.reference for e in carried.entries][-2:] == ["Ex. 20:5 (34:7; Deut. 5:9)", "Ex. 21:2"]
    assert [tuple(e) for e in got["index_entry"].entries] == [("", "IDX", "Amlici"), ("", "TG", "Faith")]
    assert len(got["translation"].sections) == 1 and got["translation"].sections[0].verses[0].text == "words"
    made = pages.translations(df.where("page_id = 'translation'").withColumn("url", F.lit("https://h/study/scriptures/jst/jst-gen/1?lang=eng"))).first()
    assert (made.book, made.comprises, made.compare, made.summary) == ("Genesis", "1-2", "Genesis 1:1", "Intro")
    assert got["talk"].speaker == "Some One" and [(p.id, p.text, p.footnote_markers) for p in got["talk"].paragraphs] == [("p1", "First words", ["1"])]
    assert [(s.session, s.slug, s.year, s.title, s.speaker) for s in got["sessions"]] == [("Morning", "11talk", 2024, "A Talk", "A Speaker"), ("Morning", "12talk", 2024, "Lone", "")]


def test_pages_that_share_a_title(spark):
    rows = spark.createDataFrame([(2, "A", ["c"]), (1, "A", ["a", "b"]), (3, "B", ["d"])], "n int, title string, entries array<string>")
    assert {r.title: r.entries for r in pages.merged_titles(rows, "n", append=True).collect()} == {"A": ["a", "b", "c"], "B": ["d"]}
    assert {r.title: r.entries for r in pages.merged_titles(rows, "n", append=False).collect()} == {"A": ["c"], "B": ["d"]}


def test_json_sink(spark, graph, tmp_path):
    corpus.write_json(graph.nodes["Book"], f"{tmp_path}/books")
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/books").collect()) == ["book/ot/ex", "book/ot/gen"]


def test_graph_is_written_and_gets_its_vectors(spark, graph, tmp_path):
    load.write_graph(graph, str(tmp_path))
    load.write_graph(graph, str(tmp_path))  # again: tables are replaced
    back = load.read_graph(spark, str(tmp_path), ["BibleDictEntry", "Verse"], ["CROSS_REF"])
    assert back.nodes["Verse"].count() == 11 and pairs(back, "CROSS_REF") == pairs(graph, "CROSS_REF")
    assert spark.read.parquet(f"{tmp_path}/rejects").count() == graph.all_rejects().count()
    vectors = spark.createDataFrame([("bd/Ark", [1.0, 2.0], None), ("bd/None", [3.0], None)], "id string, embedding array<float>, error string")
    assert [(r.id, r.embedding) for r in load.with_vectors(back, "BibleDictEntry", vectors).collect()] == [("bd/Ark", [1.0, 2.0])]
    failed = spark.createDataFrame([("bd/Ark", None, "no")], "id string, embedding array<float>, error string")
    assert load.with_vectors(back, "BibleDictEntry", failed).first()["embedding"] is None


def test_backfill_stream(spark, tmp_path):
    from quern.streaming.backfill import backfill, node_stream

    class Fake:
        def embed_batch(self, texts):
            return [[float(len(t))] for t in texts]

    schema = "id string, text string, embedding array<float>"
    spark.createDataFrame([("a", "xx", None), ("b", "", None), ("c", "y", [1.0])], schema).write.parquet(f"{tmp_path}/in")
    backfill(node_stream(spark, f"{tmp_path}/in", schema), Fake(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [(r.id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", [2.0])]
