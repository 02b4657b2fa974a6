import pytest
from pyspark.sql import functions as F

from quern.functions import books
from quern.functions.references import explode_references, parse

CASES = [
    ("Gen. 1:1", [("ot", "gen", 1, 1, 0)]),
    ("Gen. 1:1.", [("ot", "gen", 1, 1, 0)]),
    ("Gen. 1:1-3", [("ot", "gen", 1, 1, 3)]),
    ("Ex. 6:16–20", [("ot", "ex", 6, 16, 20)]),
    ("Mosiah 4:2; Morm. 9:11", [("bofm", "mosiah", 4, 2, 0), ("bofm", "morm", 9, 11, 0)]),
    ("D&C 14:9; 76:24", [("dc-testament", "dc", 14, 9, 0), ("dc-testament", "dc", 76, 24, 0)]),
    ("Matt. 23:12 (Luke 14:11; D&C 101:42)", [("nt", "matt", 23, 12, 0), ("nt", "luke", 14, 11, 0), ("dc-testament", "dc", 101, 42, 0)]),
    ("D&C 76:71 (70-71)", [("dc-testament", "dc", 76, 71, 0)]),
    ("JS—M 1:12", [("pgp", "js-m", 1, 12, 0)]),
    ("A of F 1:4", [("pgp", "a-of-f", 1, 4, 0)]),
    ("W of M 1:7", [("bofm", "w-of-m", 1, 7, 0)]),
    ("1 Chr. 3:19 (17–19); Ezra 2:2 (1–2); Hag. 1:1", [("ot", "1-chr", 3, 19, 0), ("ot", "ezra", 2, 2, 0), ("ot", "hag", 1, 1, 0)]),
    ("D&C 76:71 (70–71); 88:45; Moses 2:16; Abr. 4:16", [("dc-testament", "dc", 76, 71, 0), ("dc-testament", "dc", 88, 45, 0), ("pgp", "moses", 2, 16, 0), ("pgp", "abr", 4, 16, 0)]),
    ("1 Ne. 1:1", [("bofm", "1-ne", 1, 1, 0)]),
    ("2 Cor. 5:17-21", [("nt", "2-cor", 5, 17, 21)]),
    ("Ps. 119:105", [("ot", "ps", 119, 105, 0)]),
    ("Rev. 21:4", [("nt", "rev", 21, 4, 0)]),
    ("", []),
    ("OD 1:1", [("dc-testament", "od", 1, 1, 0)]),
    ("Alma 5:14; 7:14; 27:27", [("bofm", "alma", 5, 14, 0), ("bofm", "alma", 7, 14, 0), ("bofm", "alma", 27, 27, 0)]),
    ("3 Ne. 12:22", [("bofm", "3-ne", 12, 22, 0)]),
    ("Moses 1:29", [("pgp", "moses", 1, 29, 0)]),
    ("Isa. 53:3; 55:1", [("ot", "isa", 53, 3, 0), ("ot", "isa", 55, 1, 0)]),
    ("Gen. 5", [("ot", "gen", 5, 1, 0)]),
    ("Gen. 1:1, 3–4, 9", [("ot", "gen", 1, 1, 0), ("ot", "gen", 1, 3, 4), ("ot", "gen", 1, 9, 0)]),
    ("Matt. 23:12 (Luke 14:11); 5:3", [("nt", "matt", 23, 12, 0), ("nt", "luke", 14, 11, 0), ("nt", "luke", 5, 3, 0)]),
    ("Job 1:1 (see Appendix); (appendix)", [("ot", "job", 1, 1, 0)]),
]


@pytest.mark.parametrize("text,refs", CASES)
def test_parse(text, refs):
    assert parse(text)[0] == refs


@pytest.mark.parametrize("text,refs,errors", [("Foobar 1:1", 0, 1), ("Ex. 20:5 (34:7; Deut. 5:9)", 2, 1), ("Gen. 1:1–8:18", 0, 1), ("Gen. 1:x, 2", 1, 1), ("Gen. x", 0, 1), ("Gen.", 0, 1), (None, 0, 0)])
def test_errors_spare_the_rest(text, refs, errors):
    got = parse(text)
    assert (len(got[0]), len(got[1])) == (refs, errors)


def test_exploded(spark):
    df = spark.createDataFrame([(1, "Gen. 1:1; Nope 3"), (2, None)], "k long, cited string")
    refs, errors = explode_references(df, F.col("cited"))
    assert [(r.k, r.slug, r.ref_pos) for r in refs.collect()] == [(1, "gen", 0)]
    assert [(r.k, r.error) for r in errors.collect()] == [(1, "cannot parse chapter: Nope 3")]


def test_books():
    assert len(books.BOOKS) == 88
    assert books.BOOKS["JS—M"] == ("pgp", "js-m") and books.BOOKS["D&C"] == ("dc-testament", "dc") and books.BOOKS["1 Sam."] == ("ot", "1-sam")
    names = books.display_names()
    assert names["1 Nephi"] == names["The First Book of Nephi"] == "1 Ne." and names["The Book of Mormon"] == "Morm." and names["St John"] == "John" and names["3 John"] == "3 Jn."
