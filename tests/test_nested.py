import pytest
from pyspark.sql import functions as F

from quern.operators import nested
from quern.operators.model import Field, Model

FIELDS = [
    Field("Volume", "books", "CONTAINS", "Book"),
    Field("Book", "volume", "CONTAINS", "Volume", inward=True),
    Field("Book", "chapters", "CONTAINS", "Chapter"),
    Field("Chapter", "refs", "REF", "Chapter", properties=("note", "weight")),
]


@pytest.fixture(scope="module")
def model(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Model(
        {
            "Volume": made([("v1", "One"), ("v2", None)], "id string, name string"),
            "Book": made([("b1", "A", 1), ("b2", "B", 2), ("b3", "C", None)], "id string, name string, size int"),
            "Chapter": made([(f"c{i}", i) for i in range(6)], "id string, number int"),
        },
        {
            "CONTAINS": made([("v1", "b1"), ("v1", "b2"), ("v2", "b3"), ("b1", "c0"), ("b1", "c1"), ("b2", "c2")], "src_id string, dst_id string"),
            "REF": made([("c0", "c1", "n", 1), ("c1", "c2", "m", 2), ("c1", "c2", "again", 3), ("c2", "c0", None, None)], "src_id string, dst_id string, note string, weight int"),
        },
        FIELDS,
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def total(model, steps):
    return nested.counts(model, steps).first().asDict()


def test_nested_create_to_any_depth(model):
    book = {"id": "b9", "name": "N", "volume": {"connect": [{"where": {"id": "v1"}}]}}
    book["chapters"] = {
        "create": [{"node": {"id": "c9", "number": 9, "refs": {"connect": [{"where": {"id": "c0"}, "edge": {"note": "to"}}], "create": [{"node": {"id": "c10"}, "edge": {"weight": 4}}]}}}],
        "connect": [{"where": {"id": "c5"}}],
    }
    steps = nested.plan_create(model, "Book", nested.rows_of(model, "Book", [book, {"id": "b8", "size": 3}]))
    out = nested.applied(model, steps)
    assert rows(out.nodes["Book"])[-2:] == [("b8", None, 3), ("b9", "N", None)]
    assert rows(out.nodes["Chapter"])[-2:] == [("c5", 5), ("c9", 9)] and ("c10", None) in rows(out.nodes["Chapter"])
    assert set(rows(out.edges["CONTAINS"])) - set(rows(model.edges["CONTAINS"])) == {("v1", "b9"), ("b9", "c9"), ("b9", "c5")}
    assert set(rows(out.edges["REF"])) - set(rows(model.edges["REF"])) == {("c9", "c0", "to", None), ("c9", "c10", None, 4)}
    assert total(model, steps) == {"nodes_created": 4, "nodes_updated": 0, "nodes_deleted": 0, "relationships_created": 5, "relationships_updated": 0, "relationships_deleted": 0}
    assert out.nodes["Volume"].count() == 2


def test_connect_to_a_missing_node_makes_a_stub_or_drops_the_edge(model):
    book = nested.rows_of(model, "Book", [{"id": "b9", "name": "N", "volume": {"connect": [{"where": {"id": "nowhere"}}, {"where": {"id": "v2"}}]}}])
    out = nested.applied(model, nested.plan_create(model, "Book", book))
    assert ("nowhere", None) in rows(out.nodes["Volume"]) and ("nowhere", "b9") in rows(out.edges["CONTAINS"])
    out = nested.applied(model, nested.plan_create(model, "Book", book, "drop"))
    assert out.nodes["Volume"].count() == 2 and ("nowhere", "b9") not in rows(out.edges["CONTAINS"]) and ("v2", "b9") in rows(out.edges["CONTAINS"])


def test_a_node_that_the_same_plan_creates_isnt_a_stub(model):
    inputs = nested.rows_of(model, "Chapter", [{"id": "x1", "number": 1, "refs": {"connect": [{"where": {"id": "x2"}, "edge": {}}]}}, {"id": "x2", "number": 2}])
    out = nested.applied(model, nested.plan_create(model, "Chapter", inputs))
    assert [r for r in rows(out.nodes["Chapter"]) if r[0][0] == "x"] == [("x1", 1), ("x2", 2)]


def test_connect_by_other_fields_and_rows_without_ids(spark, model):
    inputs = nested.rows_of(model, "Volume", [{"name": "New", "books": {"connect": [{"where": {"name": "B", "size": 2}}], "create": [{"node": {"name": "made"}}]}}])
    steps = nested.plan_create(model, "Volume", inputs)
    out = nested.applied(model, steps)
    new = [r for r in rows(out.nodes["Volume"]) if r[1] == "New"]
    assert len(new) == 1 and len(new[0][0]) == 64
    assert sorted(b for v, b in rows(out.edges["CONTAINS"]) if v == new[0][0]) == sorted(["b2", [r[0] for r in rows(out.nodes["Book"]) if r[1] == "made"][0]])
    assert rows(nested.applied(model, steps).nodes["Volume"]) == rows(out.nodes["Volume"])
    with pytest.raises(ValueError):
        nested.rows_of(model, "Volume", [{"colour": 1}])


def test_create_from_a_table_of_nested_rows(spark, model):
    shape = "id string, number int, refs struct<connect: array<struct<where: struct<id: string>, edge: struct<note: string>>>>"
    table = spark.createDataFrame([("t1", 1, (([(("c0",), ("a",)), (("c1",), None)]),)), ("t2", 2, None), ("t3", 3, ([],))], shape)
    out = nested.applied(model, nested.plan_create(model, "Chapter", table))
    assert [r for r in rows(out.edges["REF"]) if r[0] == "t1"] == [("t1", "c0", "a", None), ("t1", "c1", None, None)]
    assert out.nodes["Chapter"].count() == 9


def test_nested_update_reads_the_graph_as_it_was(model):
    steps = nested.plan_update(
        model, "Book", {"size_lte": 2},
        {
            "name": "changed", "size": F.col("size") + 10,
            "volume": {"disconnect": [{}], "connect": [{"where": {"id": "v2"}}]},
            "chapters": {
                "update": {"where": {"number_gte": 1}, "node": {"number": F.col("number") * 100, "refs": {"update": {"where": {"id": "c2"}, "edge": {"weight": 7}}}}},
                "delete": [{"where": {"number": 0}}],
                "create": [{"node": {"id": "c7", "number": 7}}],
            },
        },
    )
    out = nested.applied(model, steps)
    assert rows(out.nodes["Book"]) == [("b1", "changed", 11), ("b2", "changed", 12), ("b3", "C", None)]
    assert rows(out.nodes["Chapter"]) == [("c1", 100), ("c2", 200), ("c3", 3), ("c4", 4), ("c5", 5), ("c7", 7)]
    assert rows(out.edges["CONTAINS"]) == sorted([("v2", "b3"), ("v2", "b1"), ("v2", "b2"), ("b1", "c1"), ("b2", "c2"), ("b1", "c7"), ("b2", "c7")], key=str)
    assert rows(out.edges["REF"]) == [("c1", "c2", "again", 7), ("c1", "c2", "m", 7)]
    assert total(model, steps) == {"nodes_created": 1, "nodes_updated": 4, "nodes_deleted": 1, "relationships_created": 4, "relationships_updated": 1, "relationships_deleted": 5}


def test_connect_in_an_update_doesnt_double_pairs(model):
    steps = nested.plan_update(model, "Chapter", {"id": "c1"}, {"refs": {"connect": [{"where": {"id_in": ["c2", "c3"]}, "edge": {"note": "set"}}]}})
    out = nested.applied(model, steps)
    assert [r for r in rows(out.edges["REF"]) if r[0] == "c1"] == [("c1", "c2", "set", 2), ("c1", "c2", "set", 3), ("c1", "c3", "set", None)]


def test_nothing_matched_and_bad_changes(model):
    steps = nested.plan_update(model, "Book", {"id": "none"}, {"name": "x", "chapters": {"create": [{"node": {"id": "c7"}}], "delete": [{}]}})
    out = nested.applied(model, steps)
    assert rows(out.nodes["Chapter"]) == rows(model.nodes["Chapter"]) and rows(out.edges["CONTAINS"]) == rows(model.edges["CONTAINS"])
    assert set(total(model, steps).values()) == {0} and set(total(model, []).values()) == {0}
    for bad in ({"id": "x"}, {"colour": 1}, {"chapters": {"rename": []}}):
        with pytest.raises(ValueError):
            nested.plan_update(model, "Book", {}, bad)
