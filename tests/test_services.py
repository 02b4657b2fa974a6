"""Calls, keyed streams, JSON accessors, file sources and counters."""

import glob
import hashlib
import json
import os
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.accessor import accessor, named_values, shown_values
from quern.operators import embeddings
from quern.operators.calls import ordered_calls, task_count
from quern.plans import load
from quern.plans import store as st
from quern.sources import corpus, files, pages
from quern.streaming import keyed

# --- calls ---


def test_calls_are_bounded_ordered_and_hold_the_source_back():
    lock, now, most, taken = threading.Lock(), 0, 0, []

    def slow(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 if x % 3 else 0.05)
        with lock:
            now -= 1
        return x * x

    def source():
        for i in range(40):
            taken.append(i)
            yield i

    out = []
    for r in ordered_calls(source(), slow, 4):
        out.append(r)
        assert len(taken) <= len(out) + 4
    assert out == [i * i for i in range(40)] and most == 4
    assert list(ordered_calls(range(3), slow, 1)) == [0, 1, 4]
    with pytest.raises(ZeroDivisionError):
        list(ordered_calls([1, 0, 2], lambda x: 1 // x, 2))
    with pytest.raises(ValueError):
        list(ordered_calls([1], slow, 0))
    assert task_count(10, 4) == 2
    with pytest.raises(ValueError):
        task_count(3, 4)


def slow(folder):
    """Local, so that it travels to the workers by value."""

    class Slow:
        """Writes when each call begins and ends; a batch with a bad text fails."""

        def __init__(self, folder):
            self.folder = folder

        def embed_batch(self, texts):
            begin = time.time()
            time.sleep(0.05)
            with open(f"{self.folder}/{begin}-{os.getpid()}-{threading.get_ident()}", "w") as f:
                json.dump([begin, time.time()], f)
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [[float(len(t)), 1.0] for t in texts]

    return Slow(folder)


def test_all_tasks_together_keep_to_the_limit(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", "bad" if i == 77 else "t" * (i % 9 + 1)) for i in range(240)], "id string, text string")
    made = embeddings.embed(rows, slow(str(tmp_path)), batch=4, in_flight=3, cluster_limit=6).collect()
    spans = [json.load(open(p)) for p in glob.glob(f"{tmp_path}/*")]
    most = max(sum(b <= at < e for b, e in spans) for at, _ in spans)
    assert 2 <= most <= 6
    by_id = {r.id: r for r in made}
    assert len(by_id) == 240 and by_id["n77"].error == "refused" and by_id["n77"].embedding is None
    assert all(r.embedding == [float(int(i[1:]) % 9 + 1), 1.0] for i, r in by_id.items() if i != "n77")


# --- keyed stream ---


def flaky(folder):
    """Local, so that it travels to the workers by value."""

    class Flaky:
        """Fails on texts that a file names; logs what it embeds."""

        def __init__(self, folder):
            self.folder = folder

        def embed_batch(self, texts):
            bad = open(f"{self.folder}/bad").read().split()
            with open(f"{self.folder}/log-{os.getpid()}", "a") as f:
                f.writelines(t + "\n" for t in texts if len(texts) == 1 or not set(texts) & set(bad))
            if set(texts) & set(bad):
                raise RuntimeError("refused")
            return [[float(len(t))] for t in texts]

    return Flaky(folder)


def test_only_new_and_changed_texts_are_embedded_over_restarts(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    (tmp_path / "bad").write_text("zz")

    def arrive(rows):
        spark.createDataFrame(rows, keyed.NODES).coalesce(1).write.mode("append").parquet(source)
        keyed.run(spark, source, out, flaky(str(tmp_path)), files_per_batch=2, batch=2).awaitTermination()
        log = sorted(x for p in glob.glob(f"{tmp_path}/log-*") for x in open(p).read().split())
        for p in glob.glob(f"{tmp_path}/log-*"):
            os.remove(p)
        return log, {r.id: r.embedding for r in keyed.current(spark, out).collect()}

    log, now = arrive([("a", "x", 1), ("b", "yyy", 1), ("a", "x", 1), ("c", "zz", 1), (None, "q", 1), ("d", "", 1), ("e", "old", 1), ("e", "newer", 2)])
    assert log == ["newer", "x", "yyy", "zz"] and now == {"a": [1.0], "b": [3.0], "e": [5.0]}
    (tmp_path / "bad").write_text("none")
    log, now = arrive([("a", "x", 2), ("b", "changed", 2), ("e", "late", 1)])  # a repeat, a change, one that comes late, and the failure again
    assert log == ["changed", "zz"] and now == {"a": [1.0], "b": [7.0], "c": [2.0], "e": [5.0]}
    log, now = arrive([("b", "changed", 5), ("f", "ff", None)])
    assert log == ["ff"] and now["f"] == [2.0] and len(now) == 5
    log, now = arrive([("b", "between", 4)])  # older than the repeat of version 5
    assert log == [] and now["b"] == [7.0]


def test_keyed_state_runs_no_python_and_keeps_what_no_row_touches(spark):
    known = spark.createDataFrame([("a", 5, hashlib.sha256(b"x").hexdigest()), ("b", 2, hashlib.sha256(b"y").hexdigest()), ("c", 1, hashlib.sha256(b"z").hexdigest())], keyed.STATE)
    rows = [("a", "x", 9, None), ("a", "late", 4, None), ("b", "y", 2, True), ("b", "old", 9, True), ("d", "é", None, None), ("d", "e", 0, False), (None, "q", 1, None), ("c", "", 9, None)]
    made = keyed.next_state(spark.createDataFrame(rows, keyed.RETRY), known)
    assert {r.id: (r.version, r.text, r.asked) for r in made.collect()} == {"a": (9, None, None), "b": (2, "y", 2), "c": (1, None, None), "d": (0, "é", 0)}
    assert {r.id: r.digest for r in made.collect()}["d"] == hashlib.sha256("é".encode()).hexdigest()
    assert not {"Python", "Pandas", "Arrow"} & set(re.findall("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString()))


# --- JSON ---


def test_accessor_errors_are_data(spark):
    rows = ['{"a": {"b": [1, "x", null]}}', '{"a": 3}', '{"b": 1}', "[1, 2]", '{"a": {"b": []}}', "nonsense", None, '{"a": {"b": {"c": 1}}}', '{"a": {"it\'s \\"q\\"": 5}}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")

    def run(column):
        return [(None if r.v.value is None else r.v.value, r.v.error) for r in df.orderBy("i").select(F.struct(column["value"].cast("string").alias("value"), column["error"].alias("error")).alias("v")).collect()]

    key, at = "cannot get value for key {}: {}", "cannot get value for index {}: {}"
    got = run(accessor(F.col("j")).get("a").get("b").index(1).value())
    assert got == [
        ("x", None), (None, key.format("b", "value is not a map")), (None, key.format("a", "key not found")), (None, key.format("a", "value is not a map")),
        (None, at.format(1, "index out of bounds")), (None, "not JSON"), (None, key.format("a", "value is not a map")), (None, at.format(1, "value is not an array")), (None, key.format("b", "key not found")),
    ]
    last = run(accessor(F.col("j"), keep="last").get("a").get("b").index(1).value())
    assert last[0] == ("x", None) and last[2][1] == at.format(1, "value is not an array") and last[4][1] == at.format(1, "index out of bounds")
    assert run(accessor(F.col("j")).get("a").get('it\'s "q"').value())[8] == ("5", None)
    assert run(accessor(F.col("j")).get("a").get("b").index(2).value())[0] == (None, None)  # a JSON null is a value
    assert run(accessor(F.col("j")).index(-1).value())[3] == (None, at.format(-1, "index out of bounds"))
    sizes = df.orderBy("i").select(accessor(F.col("j")).as_array().alias("v"), accessor(F.col("j")).as_map().alias("m")).select(F.size("v.value"), "v.error", "m.error").collect()
    assert sizes[3][:2] == (2, None) and sizes[0][1] == "value is not an array" and sizes[3][2] == "value is not a map" and sizes[0][2] is None
    with pytest.raises(ValueError):
        accessor(F.col("j"), keep="some")


def test_shown_metadata(spark):
    df = spark.createDataFrame([(0, "", None, "u", "x", False)], "verse int, book string, chapter string, url string, summary string, flag boolean")
    got = df.select(F.transform_values(shown_values(named_values(F.struct("*"))), lambda k, v: v.cast("string")).alias("m")).first()["m"]
    assert got == {"verse": "0", "summary": "x", "flag": "false"}


# --- files ---

PAGE = '<h1><span class="dominant">Genesis</span></h1><p class="title-number">Chapter {0}</p><p class="study-summary">S & <b>T</b> {0}</p><p class="verse"><span class="verse-number">1 </span>In the <sup class="marker">a</sup>beginning é</p>'


def test_pages_become_chapter_files_that_read_alike(spark, tmp_path):
    files.register(spark)
    tree, out = tmp_path / "pages", tmp_path / "chapters"
    for k in range(1, 8):
        (tree / "scriptures/ot/gen").mkdir(parents=True, exist_ok=True)
        (tree / f"scriptures/ot/gen/{k}.html").write_text(PAGE.format(k))
    (tree / "scriptures/readme.txt").write_text("no page")
    stored = spark.read.format("page_tree").option("prefix", "https://h.org/study/").option("split", 600).load(str(tree))
    assert stored.rdd.getNumPartitions() > 2 and stored.count() == 7
    made = pages.extract(stored, "chapter", "url").select("url", "content.*")
    part = F.split("url", "/")
    notes = F.lit(None).cast("map<string,struct<category:string,reference_text:string,text:string>>").alias("footnotes")
    rows = made.select(F.element_at(part, -3).alias("volume"), F.element_at(part, -2).alias("slug"), F.element_at(part, -1).cast("int").alias("file_number"), "url", "book", "chapter", "summary", "verses", notes)
    rows.repartition(3).write.format("chapter_files").mode("append").save(str(out))
    columns = ["volume", "slug", "file_number", "url", "book", "chapter", "summary", "verses"]
    read = corpus.read_chapters(spark, str(out)).select(columns)
    assert sorted(map(str, read.collect())) == sorted(map(str, rows.select(columns).collect())) and read.count() == 7
    text = (out / "ot/gen/3.json").read_text()
    assert text.endswith("}\n") and '  "summary": "S & T 3"' in text and "é" in text and not (out / files.STAGING).exists()

    broken = rows.withColumn("file_number", F.when(F.col("file_number") == 5, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("file_number") + 100))
    with pytest.raises(Exception, match="broken"):
        broken.repartition(3, "url").write.format("chapter_files").mode("append").save(str(out))
    assert sorted(p.name for p in out.rglob("*.json")) == [f"{k}.json" for k in range(1, 8)] and not (out / files.STAGING).exists()
    with pytest.raises(Exception, match="two rows for ot/gen/1.json"):
        rows.unionByName(rows).write.format("chapter_files").mode("append").save(str(out))
    rows.where("file_number < 3").write.format("chapter_files").mode("overwrite").save(str(out))
    assert corpus.read_chapters(spark, str(out)).count() == 2
    assert spark.read.format("page_tree").load(f"{tmp_path}/nowhere").count() == 0


# --- counters ---


def test_counters_need_no_jobs_of_their_own(spark, tmp_path):
    verse = [(1, "one", []), (2, "two", []), (None, "lost", [])]
    chapters = spark.createDataFrame([("", "Genesis", c, "s", verse, {}, "ot", "gen", c) for c in (1, 2)], "url string, book string, chapter int, summary string, verses array<struct<number:int,text:string,footnote_markers:array<string>>>, footnotes map<string,struct<category:string,reference_text:string,text:string>>, volume string, slug string, file_number int")
    graph = load.load_tables(chapters, load.read_studies(spark, f"{tmp_path}/none"))
    vectors = spark.createDataFrame([("ch/ot/gen/1", [1.0], None)], "id string, embedding array<float>, error string")
    graph.nodes["Chapter"] = load.with_vectors(graph, "Chapter", vectors)
    store, counters = st.GraphStore(spark, f"{tmp_path}/store"), st.Counters()
    st.save_graph(store, graph, 2, counters=counters)
    got = counters.values()
    assert len(set(got) - {k for k in got if k.startswith("Warnings")}) == 29
    kept = st.open_graph(store)
    assert got["Verses"] == kept.nodes["Verse"].count() == 4 and got["Chapters"] == 2 and got["Volumes"] == 5 and got["VerseGroups"] == 2 and got["EmbChapters"] == 1 and got["EmbVerseGroups"] == 0
    assert got["Warnings"] == got["Warnings: scriptures"] == store.table("rejects").count() == 2
    for name, table in (st.COUNTERS | st.EMBEDDED).items():
        if name in st.COUNTERS:
            assert got[name] == store.table(table).count(), name


def test_list_helpers_name_the_first_error(spark):
    from quern.functions import collections as c

    df = spark.createDataFrame([(1, [1, 2, 3], {"b": 1, "a": 2}), (2, [1, 0, -4], {})], "i int, a array<int>, m map<string,int>")
    wrong = lambda x: F.when(x <= 0, F.concat(F.lit("bad "), x.cast("string")))
    rows = df.orderBy("i").select(c.map_checked(F.col("a"), lambda x: x * 2, wrong).alias("r"), c.keys(F.col("m")).alias("k"), c.values(F.col("m")).alias("v")).collect()
    assert rows[0].r.asDict() == {"values": [2, 4, 6], "error": None} and rows[1].r.asDict() == {"values": None, "error": "bad 0"}
    assert rows[0].k == ["a", "b"] and rows[0].v == [2, 1]
    with pytest.raises(Exception, match="bad 0"):
        df.select(c.map_or_fail(F.col("a"), lambda x: x * 2, wrong)).collect()
