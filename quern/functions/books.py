"""Books of the corpus: abbreviations, volumes, slugs and names as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Volumes; books in order, with their abbreviation, volume, slug and name; other names that sources use.
VOLUMES = {"ot": "Old Testament", "nt": "New Testament", "bofm": "Book of Mormon", "dc-testament": "Doctrine and Covenants", "pgp": "Pearl of Great Price"}
TABLE = [
    # Old Testament
    ("Gen.", "ot", "gen", "Genesis"),
    ("Ex.", "ot", "ex", "Exodus"),
    ("Lev.", "ot", "lev", "Leviticus"),
    ("Num.", "ot", "num", "Numbers"),
    ("Deut.", "ot", "deut", "Deuteronomy"),
    ("Josh.", "ot", "josh", "Joshua"),
    ("Judg.", "ot", "judg", "Judges"),
    ("Ruth", "ot", "ruth", "Ruth"),
    ("1 Sam.", "ot", "1-sam", "1 Samuel"),
    ("2 Sam.", "ot", "2-sam", "2 Samuel"),
    ("1 Kgs.", "ot", "1-kgs", "1 Kings"),
    ("2 Kgs.", "ot", "2-kgs", "2 Kings"),
    ("1 Chr.", "ot", "1-chr", "1 Chronicles"),
    ("2 Chr.", "ot", "2-chr", "2 Chronicles"),
    ("Ezra", "ot", "ezra", "Ezra"),
    ("Neh.", "ot", "neh", "Nehemiah"),
    ("Esth.", "ot", "esth", "Esther"),
    ("Job", "ot", "job", "Job"),
    ("Ps.", "ot", "ps", "Psalms"),
    ("Prov.", "ot", "prov", "Proverbs"),
    ("Eccl.", "ot", "eccl", "Ecclesiastes"),
    ("Song", "ot", "song", "Song of Solomon"),
    ("Isa.", "ot", "isa", "Isaiah"),
    ("Jer.", "ot", "jer", "Jeremiah"),
    ("Lam.", "ot", "lam", "Lamentations"),
    ("Ezek.", "ot", "ezek", "Ezekiel"),
    ("Dan.", "ot", "dan", "Daniel"),
    ("Hosea", "ot", "hosea", "Hosea"),
    ("Joel", "ot", "joel", "Joel"),
    ("Amos", "ot", "amos", "Amos"),
    ("Obad.", "ot", "obad", "Obadiah"),
    ("Jonah", "ot", "jonah", "Jonah"),
    ("Micah", "ot", "micah", "Micah"),
    ("Nahum", "ot", "nahum", "Nahum"),
    ("Hab.", "ot", "hab", "Habakkuk"),
    ("Zeph.", "ot", "zeph", "Zephaniah"),
    ("Hag.", "ot", "hag", "Haggai"),
    ("Zech.", "ot", "zech", "Zechariah"),
    ("Mal.", "ot", "mal", "Malachi"),
    # New Testament
    ("Matt.", "nt", "matt", "Matthew"),
    ("Mark", "nt", "mark", "Mark"),
    ("Luke", "nt", "luke", "Luke"),
    ("John", "nt", "john", "John"),
    ("Acts", "nt", "acts", "Acts"),
    ("Rom.", "nt", "rom", "Romans"),
    ("1 Cor.", "nt", "1-cor", "1 Corinthians"),
    ("2 Cor.", "nt", "2-cor", "2 Corinthians"),
    ("Gal.", "nt", "gal", "Galatians"),
    ("Eph.", "nt", "eph", "Ephesians"),
    ("Philip.", "nt", "philip", "Philippians"),
    ("Col.", "nt", "col", "Colossians"),
    ("1 Thes.", "nt", "1-thes", "1 Thessalonians"),
    ("2 Thes.", "nt", "2-thes", "2 Thessalonians"),
    ("1 Tim.", "nt", "1-tim", "1 Timothy"),
    ("2 Tim.", "nt", "2-tim", "2 Timothy"),
    ("Titus", "nt", "titus", "Titus"),
    ("Philem.", "nt", "philem", "Philemon"),
    ("Heb.", "nt", "heb", "Hebrews"),
    ("James", "nt", "james", "James"),
    ("1 Pet.", "nt", "1-pet", "1 Peter"),
    ("2 Pet.", "nt", "2-pet", "2 Peter"),
    ("1 Jn.", "nt", "1-jn", "1 John"),
    ("2 Jn.", "nt", "2-jn", "2 John"),
    ("3 Jn.", "nt", "3-jn", "3 John"),
    ("Jude", "nt", "jude", "Jude"),
    ("Rev.", "nt", "rev", "Revelation"),
    # Book of Mormon
    ("1 Ne.", "bofm", "1-ne", "1 Nephi"),
    ("2 Ne.", "bofm", "2-ne", "2 Nephi"),
    ("Jacob", "bofm", "jacob", "Jacob"),
    ("Enos", "bofm", "enos", "Enos"),
    ("Jarom", "bofm", "jarom", "Jarom"),
    ("Omni", "bofm", "omni", "Omni"),
    ("W of M", "bofm", "w-of-m", "Words of Mormon"),
    ("Mosiah", "bofm", "mosiah", "Mosiah"),
    ("Alma", "bofm", "alma", "Alma"),
    ("Hel.", "bofm", "hel", "Helaman"),
    ("3 Ne.", "bofm", "3-ne", "3 Nephi"),
    ("4 Ne.", "bofm", "4-ne", "4 Nephi"),
    ("Morm.", "bofm", "morm", "Mormon"),
    ("Ether", "bofm", "ether", "Ether"),
    ("Moro.", "bofm", "moro", "Moroni"),
    # Doctrine and Covenants
    ("D&C", "dc-testament", "dc", "Doctrine and Covenants"),
    ("OD", "dc-testament", "od", "Official Declaration"),
    # Pearl of Great Price
    ("Moses", "pgp", "moses", "Moses"),
    ("Abr.", "pgp", "abr", "Abraham"),
    ("JS—M", "pgp", "js-m", "Joseph Smith—Matthew"),
    ("JS—H", "pgp", "js-h", "Joseph Smith—History"),
    ("A of F", "pgp", "a-of-f", "Articles of Faith"),
]
OTHER_NAMES = {
    "Psalm": "Ps.",
    "The First Book of Nephi": "1 Ne.",
    "The Second Book of Nephi": "2 Ne.",
    "Third Nephi": "3 Ne.",
    "Fourth Nephi": "4 Ne.",
    "The Words of Mormon": "W of M",
    "The Articles of Faith": "A of F",
    "St Matthew": "Matt.",
    "St Mark": "Mark",
    "St Luke": "Luke",
    "St John": "John",
    "The Book of Jacob": "Jacob",
    "The Book of Enos": "Enos",
    "The Book of Jarom": "Jarom",
    "The Book of Omni": "Omni",
    "The Book of Mosiah": "Mosiah",
    "The Book of Alma": "Alma",
    "The Book of Helaman": "Hel.",
    "The Book of Mormon": "Morm.",
    "The Book of Ether": "Ether",
    "The Book of Moroni": "Moro.",
    "The Book of Moses": "Moses",
    "The Book of Abraham": "Abr.",
}

BOOKS = {abbreviation: (volume, slug) for abbreviation, volume, slug, _ in TABLE}


def display_names() -> dict[str, str]:
    """Name to abbreviation."""
    return {name: abbreviation for abbreviation, _, _, name in TABLE} | OTHER_NAMES


def volume_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"vol/{v}", v, n, k) for k, (v, n) in enumerate(VOLUMES.items())], "id string, abbreviation string, name string, pos int")


def book_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLE, "abbreviation string, volume string, slug string, name string")


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *BOOKS[a]) for n, a in display_names().items()], "name string, volume string, slug string")
