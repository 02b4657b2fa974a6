"""Free-text citations ("Matt. 23:12 (Luke 14:11); 5:3") to rows.

The grammar works on one short string at a time, so it is a small Python function behind an Arrow UDF; the rest
(exploding, joining with verses, rejects) is DataFrame work.

Segments stand between semicolons outside of parentheses. A segment is a main citation and an optional parenthesis, which
is ignored when it holds only numbers, "appendix" or "see ..."; otherwise it is a citation list of its own that inherits no
book. A segment without a book inherits that of the last citation before it, those in parentheses included. A chapter
without verses means its first verse; dashes of any kind make ranges; a bad item gives an error and spares the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .books import BOOKS

REF = T.StructType([T.StructField("volume", T.StringType()), T.StructField("slug", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("chapter", "verse", "end_verse"))])
PARSED = T.StructType([T.StructField("refs", T.ArrayType(REF)), T.StructField("errors", T.ArrayType(T.StringType()))])

ARROW_REFS = pa.list_(pa.struct([("volume", pa.string()), ("slug", pa.string()), *((n, pa.int32()) for n in ("chapter", "verse", "end_verse"))]))

_BOOK = re.compile("(" + "|".join(re.escape(a) for a in sorted(BOOKS, key=len, reverse=True)) + r")(?=[ \t]|$)")
_ITEM = re.compile(r"([+-]?[0-9]+)(?:\s*[-–—]\s*([+-]?[0-9]+))?\Z")
_NUMBER = re.compile(r"[+-]?[0-9]+\Z")


def _segments(text: str) -> list[str]:
    depth, parts, last = 0, [], 0
    for m in re.finditer(r"[();]", text):
        if m[0] == ";" and depth == 0:
            parts.append(text[last : m.start()])
            last = m.end()
        elif m[0] != ";":
            depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
    return [p for p in ((s.strip().rstrip(".")).strip() for s in [*parts, text[last:]]) if p]


def _citation(text: str, inherited: tuple[str, str] | None) -> tuple[list[tuple], list[str]]:
    text = text.strip().rstrip(".")
    named = _BOOK.match(text)
    book = BOOKS[named[1]] if named else inherited
    if not book:
        return [], [f"cannot parse reference: {text}"]
    place = text[named.end() :].strip() if named else text
    if not place:
        return [], [f"empty chapter:verse for {book[0]}/{book[1]}"]
    chapter, colon, verses = (x.strip() for x in place.partition(":"))
    if not _NUMBER.match(chapter):
        return [], [f"cannot parse chapter{' number' if colon else ''}: {chapter}"]
    if not colon:
        return [(*book, int(chapter), 1, 0)], []
    refs, errors = [], []
    for item in filter(None, (v.strip() for v in verses.split(","))):
        m = _ITEM.match(item)
        if m:
            refs.append((*book, int(chapter), int(m[1]), int(m[2] or 0)))
        else:
            errors.append(f"cannot parse verse{' range' if re.search('[-–—]', item) else ' number'}: {item}")
    return refs, errors


def parse(text: str | None) -> tuple[list[tuple], list[str]]:
    """(volume, slug, chapter, verse, end verse or 0) of each citation, and errors."""
    refs: list[tuple] = []
    errors: list[str] = []
    book = None
    for segment in _segments((text or "").strip().rstrip(".")):
        main, opened, inner = segment.partition("(")
        if opened and not main.strip():
            main, opened = segment, ""
        found, wrong = _citation(main, book)
        if opened:
            inner = (inner[: inner.rfind(")")] if ")" in inner else inner).strip()
            if inner and not re.fullmatch(r"[\d\s,\-–]+", inner, re.ASCII) and inner.lower() != "appendix" and not inner.lower().startswith("see "):
                more, worse = parse(inner)
                found, wrong = found + more, wrong + worse
        refs += found
        errors += wrong
        if found:
            book = found[-1][:2]
    return refs, errors


@lru_cache(maxsize=2_000)  # small: each of an executor's workers holds one
def _parsed(text: str | None) -> tuple[list[tuple], list[str]]:
    return parse(text)


def _lists(groups: list[list], kind: pa.DataType, make: Callable[[list], pa.Array]) -> pa.Array:
    """A list array of the groups, from one flat array."""
    starts = [0]
    for g in groups:
        starts.append(starts[-1] + len(g))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), make([x for g in groups for x in g])).cast(kind)


def _ref_array(refs: list[tuple]) -> pa.Array:
    kinds = ARROW_REFS.value_type
    columns = zip(*refs, strict=True) if refs else [()] * kinds.num_fields
    return pa.StructArray.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(columns)], fields=list(kinds))


@F.arrow_udf(PARSED)
def parse_references(texts: pa.Array) -> pa.Array:
    """Each distinct text of a batch is parsed once, and a few texts that many batches share are kept."""
    seen = texts.dictionary_encode()
    made = [_parsed(t) for t in seen.dictionary.to_pylist()]
    refs = _lists([r for r, _ in made], ARROW_REFS, _ref_array)
    errors = _lists([e for _, e in made], pa.list_(pa.string()), lambda x: pa.array(x, pa.string()))
    found = pa.StructArray.from_arrays([refs, errors], ["refs", "errors"])
    return found.take(seen.indices.fill_null(0)) if len(found) else pa.nulls(len(texts), found.type)


def explode_references(rows: DataFrame, text: Column, keep: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """(rows with volume, slug, chapter, verse, end_verse and ref_pos for each citation; rows with error for each failure). keep: what is done with
    the parsed rows, of which both are made."""
    parsed = keep(rows.withColumn("quern_cited", F.coalesce(text, F.lit(""))).withColumn("parsed", parse_references("quern_cited")))
    refs = parsed.select(*rows.columns, F.posexplode("parsed.refs").alias("ref_pos", "ref")).select(*rows.columns, "ref_pos", "ref.*")
    return refs, parsed.select(*rows.columns, F.explode("parsed.errors").alias("error"))
