"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of references that a footnote's text may announce.
MARKS = ("TG", "BD", "JST", "HEB", "GR", "IE")


def normalize_whitespace(s: Column) -> Column:
    """Runs of any Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_dots(s: Column) -> Column:
    return F.regexp_replace(s, r"\.+$", "")


def footnote_key(s: Column) -> Column:
    """"12b" to (12, "b"); without leading digits (0, "")."""
    digits = F.regexp_extract(s, r"^([0-9]+)", 1)
    number = digits.try_cast("int")
    good = number.isNotNull()
    return F.struct(F.when(good, number).otherwise(0).alias("verse"), F.when(good, F.regexp_extract(s, r"^[0-9]+((?s:.*))$", 1)).otherwise("").alias("marker"))


def cross_reference_part(s: Column) -> Column:
    """The text before the first announced kind; empty when it starts with one."""
    marks = "|".join(MARKS)
    cut = F.regexp_replace(s, rf"(?s) (?:{marks}) .*$", "")
    return F.when(s.rlike(rf"^(?:{marks}) "), "").otherwise(strip_dots(F.trim(cut)))


def topics(s: Column) -> Column:
    """Topic names after the first "TG "."""
    rest = F.regexp_replace(F.regexp_extract(s, r"(?s)TG (.*)$", 1), r"(?s) (?:BD|JST|HEB|GR|IE) .*$", "")
    parts = F.transform(F.split(F.trim(strip_dots(rest)), ";"), lambda x: strip_dots(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def dictionary_entry(s: Column) -> Column:
    """The name after "BD " up to the first dot, or empty."""
    return F.trim(F.regexp_extract(s, r"(?s)BD ([^.]*)", 1))


def translation_reference(s: Column) -> Column:
    """The reference after "JST ": up to the end of its verse range, dashes of any kind."""
    rest = F.trim(F.regexp_extract(s, r"(?s)JST (.*)$", 1))
    cut = F.regexp_extract(rest, r"(?s)^([^:]*:[0-9\-–—]*)", 1)
    return F.trim(strip_dots(F.when(cut != "", cut).otherwise(rest)))


def split_composite(ref: Column) -> Column:
    """"Ex. 4:10–16, 27–31" to two references of the same chapter; cut at the last colon."""
    head = F.regexp_extract(ref, r"(?s)^(.*:)", 1)
    tail = F.regexp_extract(ref, r"(?s)^.*:(.*)$", 1)
    return F.when(tail.contains(", "), F.transform(F.split(tail, ", "), lambda x: F.concat(head, x))).otherwise(F.array(ref))


STARTS_VERSE = r"[0-9]+(?:[:–-]|$)"


def book_prefix(ref: Column) -> Column:
    """The text before the first digit that starts a chapter and verse."""
    found = F.regexp_extract(ref, rf"(?s)^(.*?){STARTS_VERSE}", 1)
    return F.when(ref.rlike(STARTS_VERSE), F.regexp_replace(found, " +$", "")).otherwise(ref)


def carry_book_prefix(entries: Column) -> Column:
    """Entries (phrase, reference, key) in which references that start with a chapter get the last named book; cross references
    (with a key) pass by."""
    empty = F.struct(F.lit("").alias("book"), F.slice(entries, 1, 0).alias("out"))

    def step(state: Column, e: Column) -> Column:
        bare = e.reference.rlike("^" + STARTS_VERSE)
        full = F.when(bare & (state.book != ""), F.concat(state.book, F.lit(" "), e.reference)).otherwise(e.reference)
        moved = F.when(e.key == "", e.withField("reference", full)).otherwise(e)
        return F.struct(F.when(bare | (e.key != ""), state.book).otherwise(book_prefix(e.reference)).alias("book"), F.concat(state.out, F.array(moved)).alias("out"))

    return F.aggregate(entries, empty, step, lambda s: s.out)


def phrase_text(name: Column, phrases: Column, most: int = 20) -> Column:
    """"name. p1; p2" of the first `most` phrases."""
    some = F.array_join(F.slice(phrases, 1, most), "; ")
    return F.when(F.size(phrases) > 0, F.concat_ws(". ", F.nullif(name, F.lit("")), some)).otherwise(F.coalesce(name, F.lit("")))


def summary_and_text(summary: Column, text: Column) -> Column:
    return F.when(F.coalesce(summary, F.lit("")) == "", text).otherwise(F.concat_ws(" ", summary, text))


def truncate(s: Column, most: int) -> Column:
    """By characters, so that none is split."""
    return F.substring(s, 1, most)


def shortened(s: Column, most: int = 300) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def relevance_percent(distance: Column) -> Column:
    return F.floor((1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance))) * 100 + 0.5).cast("int")


def chapter_of_url(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)


def is_chapter_url(url: Column) -> Column:
    """At least five path segments."""
    return F.size(F.filter(F.split(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")) >= 5


def cache_path(url: Column, folder: str) -> Column:
    """/study/<rel> to <folder>/<rel>.html; null for other paths."""
    rel = F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"^/study/(.+?)/*$", 1)
    return F.when(rel != "", F.concat(F.lit(folder.rstrip("/") + "/"), rel, F.lit(".html")))


def talk_slug(url: Column) -> Column:
    return F.regexp_extract(url, r"/study/general-conference/(\d{4})/(\d{1,2})/([^/?#]+)", 3)


def year_month(s: Column) -> Column:
    """(year, month) of YYYY-MM or YYYY/MM, null otherwise; the month isn't checked."""
    parts = F.split(F.replace(F.trim(s), F.lit("/"), F.lit("-")), "-")
    year, month = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 2) & year.isNotNull() & month.isNotNull(), F.struct(year.alias("year"), month.alias("month")))


def conference_grid(first: tuple[int | Column, int | Column], last: tuple[int | Column, int | Column]) -> Column:
    """All (year, month), month 4 or 10, from first to last inclusive."""
    (y1, m1), (y2, m2) = ((F.lit(y).cast("int"), F.lit(m).cast("int")) for y, m in (first, last))
    grid = F.flatten(F.transform(F.sequence(y1, y2), lambda y: F.array(*(F.struct(y.alias("year"), F.lit(m).alias("month")) for m in (4, 10)))))
    return F.filter(grid, lambda g: (g.year * 12 + g.month).between(y1 * 12 + m1, y2 * 12 + m2))


def latest_conference(day: Column) -> Column:
    """The latest April or October that has passed by a date, as YYYY-MM."""
    y, m = F.year(day), F.month(day)
    return F.when(m >= 10, F.format_string("%d-10", y)).when(m >= 4, F.format_string("%d-04", y)).otherwise(F.format_string("%d-10", y - 1))


def sha256_hex(s: Column) -> Column:
    """Null hashes as the empty text."""
    return F.sha2(F.coalesce(s, F.lit("")).cast("binary"), 256)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def from_rfc3339(s: Column) -> Column:
    return F.try_to_timestamp(s)


def host_and_port(url: Column, default: int = 6379) -> Column:
    """Null host where there is none, null port where it isn't a number."""
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^@/]*@)?([^/?#]*)", 1)
    host, port = F.substring_index(rest, ":", 1), F.when(rest.contains(":"), F.substring_index(rest, ":", -1))
    return F.struct(F.nullif(host, F.lit("")).alias("host"), F.when(port.isNull(), F.lit(default)).otherwise(port.try_cast("int")).alias("port"))


def translation_heading(heading: Column, page_chapter: Column) -> Column:
    """(book, comprises) of a heading like "JST, Genesis 9:4–6": the reference begins with the last word that holds a colon, and
    the chapter goes when it is the page's own."""
    flat = F.rtrim(F.regexp_replace(F.regexp_replace(normalize_whitespace(heading), "^JST, ", ""), "[. ]+$", ""))
    found = flat.contains(":")
    book = F.when(found, F.rtrim(F.regexp_extract(flat, r"^(.* |)[^ ]*:[^ ]*(?: [^ :]*)*$", 1))).otherwise(flat)
    ref = F.when(found, F.ltrim(F.substr(flat, F.length(book) + 1))).otherwise("")
    own = F.substring_index(ref, ":", 1) == page_chapter
    plain = F.translate(F.when(own & ref.contains(":"), F.regexp_extract(ref, "^[^:]*:(.*)$", 1)).otherwise(ref), "–—", "--")
    return F.struct(book.alias("book"), plain.alias("comprises"))
