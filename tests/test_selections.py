import random

import pytest
from pyspark.sql import functions as F

from quern.operators import predicates, selections
from quern.operators.model import Field, Model


def order(v, direction):
    """Sorts nulls last when ascending and first when descending."""
    none = v is None
    if direction == "ASC":
        return (none, 0 if none else v)
    return (not none, 0 if none else -v)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    books = [(i, f"b{i}") for i in range(8)]
    verses = [(100 + i, rng.choice([None, 1, 2, 3, 4, 5]), rng.choice("xyz")) for i in range(60)]
    edges = sorted({(rng.randrange(7), 100 + rng.randrange(60), rng.choice(["p", "q", None])) for _ in range(150)}, key=str)
    links = sorted({(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(90)})
    return books, verses, edges, links


@pytest.fixture(scope="module")
def model(spark, data):
    books, verses, edges, links = data
    fields = [Field("Book", "verses", "HAS", "Verse", properties=("mark",)), Field("Verse", "books", "HAS", "Book", inward=True, properties=("mark",)), Field("Verse", "refs", "REF", "Verse")]
    return Model(
        {"Book": spark.createDataFrame(books, "id int, name string"), "Verse": spark.createDataFrame(verses, "id int, number int, kind string")},
        {"HAS": spark.createDataFrame(edges, "src_id int, dst_id int, mark string"), "REF": spark.createDataFrame(links, "src_id int, dst_id int")},
        fields,
    )


def expected(data, direction, keep=lambda v: True):
    _, verses, edges, _ = data
    by_id = {v[0]: v for v in verses}
    out = {b: [] for b in range(8)}
    for b, v, mark in edges:
        if keep(by_id[v]):
            out[b].append((v, by_id[v][1], mark))
    for rows in out.values():
        rows.sort(key=lambda r: (order(r[1], direction), r[0], (r[2] is None, r[2] or "")))
    return out


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_every_parent_pages_by_its_own_cursor(spark, data, model, direction):
    want = expected(data, direction, lambda v: v[2] != "z")
    label, after, ends = model.label("Book"), None, {}
    got, pages = {b: [] for b in range(8)}, 0
    parents = model.nodes["Book"].select(F.col("id").alias("parent"))
    more = True
    while more:
        page = selections.parsed({"first": 4, "after": after, "where": {"kind_not": "z"}, "sort": [{"number": direction}], "totalCount": True})
        rows = selections.connection(label, "verses", page, parents).collect()
        assert len(rows) == 8
        more = False
        for r in rows:
            c = r.connection
            assert c.totalCount == len(want[r.parent]) and len(c.edges) <= 4
            got[r.parent] += [(e.node.id, e.node.number, e.properties.mark) for e in c.edges]
            assert c.pageInfo.hasNextPage == (len(got[r.parent]) < len(want[r.parent]))
            assert c.pageInfo.hasPreviousPage == (ends.get(r.parent) is not None)
            if c.edges:
                assert c.pageInfo.startCursor == c.edges[0].cursor and c.pageInfo.endCursor == c.edges[-1].cursor
                ends[r.parent] = c.pageInfo.endCursor
            more |= c.pageInfo.hasNextPage
        after, pages = spark.createDataFrame([(b, ends.get(b)) for b in range(8)], "book int, mark string"), pages + 1
    assert got == want and pages > 2


def test_nested_selection(data, model):
    books, verses, edges, links = data
    by_id = {v[0]: v for v in verses}
    rows = selections.selected(
        model.label("Book"),
        {"where": {"id_lt": 5}, "sort": [{"name": "DESC"}], "fields": ["name"], "versesConnection": {"first": 2, "sort": [{"number": "DESC"}], "fields": ["id"], "properties": [], "refsConnection": {"first": 2, "where": {"kind": "x"}, "fields": ["id", "kind"], "totalCount": True}}},
    ).collect()
    want = expected(data, "DESC")
    assert [r.name for r in rows] == ["b4", "b3", "b2", "b1", "b0"]
    for r in rows:
        top = want[int(r.name[1:])][:2]
        assert [e.node.id for e in r.versesConnection.edges] == [v for v, _, _ in top]
        for e in r.versesConnection.edges:
            reached = sorted(b for a, b in links if a == e.node.id and by_id[b][2] == "x")
            assert [x.node.id for x in e.node.refsConnection.edges] == reached[:2]
            assert e.node.refsConnection.totalCount == len(reached)
            assert "properties" not in e.asDict()


def test_root_pages_and_inward_fields(data, model):
    label = model.label("Verse")
    first = selections.selected(label, {"first": 3, "sort": [{"number": "ASC"}], "fields": ["id", "number"], "booksConnection": {}}).collect()
    want = sorted(data[1], key=lambda v: (order(v[1], "ASC"), v[0]))
    assert [r.id for r in first] == [v[0] for v in want[:3]]
    assert [{e.node.id for e in r.booksConnection.edges} for r in first] == [{b for b, v, _ in data[2] if v == r.id} for r in first]
    from quern.operators.paging import encode_cursor

    after = encode_cursor([first[-1].number, first[-1].id])
    assert [r.id for r in selections.selected(label, {"first": 3, "after": after, "sort": [{"number": "ASC"}]}).collect()] == [v[0] for v in want[3:6]]


def test_a_hot_parent_is_cut_before_the_shuffle(model):
    rows = selections.page_rows(model.label("Book"), "verses", selections.Page(first=3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_first_none_and_errors(spark, model):
    label, parents = model.label("Book"), model.nodes["Book"].select(F.col("id").alias("parent"))
    rows = {r.parent: r.connection for r in selections.connection(label, "verses", selections.Page(first=0), parents).collect()}
    assert rows[0].edges == [] and rows[0].pageInfo.hasNextPage and not rows[7].pageInfo.hasNextPage
    for bad in ({"colour": 1}, {"first": -1}):
        with pytest.raises(ValueError):
            selections.parsed(bad)
    for bad in ({"wordsConnection": {}}, {"versesConnection": {"sort": [{"colour": "ASC"}]}}, {"versesConnection": {"fields": ["colour"]}}, {"fields": ["colour"]}, {"versesConnection": {"sort": [{"number": "UP"}]}}):
        with pytest.raises(ValueError):
            selections.selected(label, bad)
    with pytest.raises(Exception, match="not a cursor"):
        selections.connection(label, "verses", selections.Page(first=1, after="bm8="), parents).collect()
    assert selections.selected(label, {"where": {"id": 99}, "versesConnection": {"first": 2}}).collect() == []


def test_regex_matches_to_the_very_end(spark):
    label = predicates.Label(spark.createDataFrame([(1, "abc"), (2, "abc\n")], "id int, t string"))
    assert [r.id for r in predicates.filtered(label, {"t_regex": "abc"}).collect()] == [1]
