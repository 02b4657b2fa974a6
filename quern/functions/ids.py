"""Node keys, built from natural keys so that joins never need generated ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(prefix: str, *parts: Column | str) -> Column:
    return F.concat_ws("/", F.lit(prefix), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def volume_id(volume) -> Column:
    return _joined("vol", volume)


def book_id(volume, slug) -> Column:
    return _joined("book", volume, slug)


def chapter_id(volume, slug, chapter) -> Column:
    return _joined("ch", volume, slug, chapter)


def verse_id(volume, slug, chapter, verse) -> Column:
    return _joined("v", volume, slug, chapter, verse)


def verse_group_id(volume, slug, chapter, first, last) -> Column:
    c = F.col(first) if isinstance(first, str) else first
    d = F.col(last) if isinstance(last, str) else last
    return F.concat(_joined("vg", volume, slug, chapter), F.lit("/"), c.cast("string"), F.lit("-"), d.cast("string"))


def topic_id(name) -> Column:
    return _joined("tg", name)


def dictionary_id(name) -> Column:
    return _joined("bd", name)


def index_id(name) -> Column:
    return _joined("idx", name)


def jst_id(slug, chapter, comprises) -> Column:
    return _joined("jst", slug, chapter, comprises)


def part_of_id(key: Column, place: int) -> Column:
    """Segment of a key, empty where there is none: 1 is the volume of a verse id, 2 its book."""
    return F.coalesce(F.get(F.split(key, "/"), F.lit(place)), F.lit(""))
