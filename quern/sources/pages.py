"""Extraction from stored HTML pages: links of index pages, and the structured content of each kind of page.

Links of index pages are regular expressions in the JVM. For content every page becomes a row that holds its nodes in document order, each with its
place and that of its last descendant; what is inside a node is then a slice of that list. The readers of each kind of page are filters, slices and
transforms of it: nothing is joined or shuffled, so the work grows with the pages and no table of nodes is built anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import carry_book_prefix, chapter_of_url, normalize_whitespace, translation_heading

HOST = "https://www.churchofjesuschrist.org"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def index_links(html: Column, part: str, skip: tuple[str, ...] = ("/introduction",), fewest_segments: int = 0) -> Column:
    """Links that hold `part`, each once in page order, with the host in front: topic, dictionary, index and translation lists."""
    def wanted(x: Column) -> Column:
        good = x.contains(part)
        for s in skip:
            good = good & ~F.regexp_replace(x, r"[?#].*$", "").endswith(s)
        if fewest_segments:
            good = good & (F.size(F.filter(F.split(F.regexp_replace(x, r"[?#].*$", ""), "/"), lambda y: y != "")) >= fewest_segments)
        return good

    return F.transform(F.array_distinct(F.filter(hrefs(html), wanted)), lambda x: F.when(x.startswith("/"), F.concat(F.lit(HOST), x)).otherwise(x))


class _Rows(HTMLParser):
    """The nodes of a page in document order: elements that an end tag closes when it is theirs, and texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, 0, 0, "", {}, None]]  # at, last, depth, name, attributes, text
        self.open = [0]

    def _add(self, name: str, attributes: dict, text: str | None) -> int:
        at = len(self.rows)
        self.rows.append([at, at, len(self.open), name, attributes, text])
        return at

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(at)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[k]][3] == tag:
                self._end(k)
                return

    def handle_data(self, data):
        self._add("", {}, data)

    def _end(self, k: int) -> None:
        for at in self.open[k:]:
            self.rows[at][1] = len(self.rows) - 1
        del self.open[k:]

    def finished(self) -> list[list]:
        self.close()
        self._end(0)
        return self.rows


NODE = "struct<at:int,last:int,depth:int,name:string,attributes:map<string,string>,words:string>"
ARROW_NODE = [("at", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("words", pa.string())]
#: Nodes in one batch that a task sends to the JVM; a page with more stands alone.
BATCH_NODES = 20_000


def _batch(keys: pa.Array, pages: list[list[list]]) -> pa.RecordBatch:
    rows = [r for page in pages for r in page]
    columns = [pa.array([list(r[k].items()) if name == "attributes" else r[k] for r in rows], kind) for k, (name, kind) in enumerate(ARROW_NODE)]
    starts = [0]
    for page in pages:
        starts.append(starts[-1] + len(page))
    nodes = pa.StructArray.from_arrays(columns, [name for name, _ in ARROW_NODE])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), nodes)], ["page", "nodes"])


def _page_nodes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        html, pages, first, size = batch.column("html"), [], 0, 0
        for i in range(batch.num_rows):
            page = _Rows()
            page.feed(html[i].as_py() or "")
            pages.append(page.finished())
            size += len(pages[-1])
            if size >= BATCH_NODES or i + 1 == batch.num_rows:
                yield _batch(batch.column("page").slice(first, len(pages)), pages)
                pages, first, size = [], i + 1, 0


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page (the key) and nodes: of each node at (its place in the document, which is its place in the list), last (that of its last descendant), depth,
    name ('' for text and for the page itself, which is at 0), attributes, words (of text nodes). A node is inside another if its place is between
    the other's at and last."""
    return pages.select(F.col(key).alias("page"), F.col(html).alias("html")).mapInArrow(_page_nodes, f"page {dict(pages.dtypes)[key]}, nodes array<{NODE}>")


# --- what readers are made of: columns that are nodes or lists of nodes in document order ------------------------------------------------------

Test = Callable[[Column], Column]


def let(value: Column, use: Test) -> Column:
    """What `use` makes of the value, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attribute(node: Column, name: str) -> Column:
    return F.coalesce(node["attributes"][name], F.lit(""))


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(F.split(attribute(node, "class"), r"\s+"), name)


def is_mark(node: Column) -> Column:
    """Markers, verse numbers and icons, which don't belong to a text."""
    return (node["name"] == "sup") | F.exists(F.split(attribute(node, "class"), r"\s+"), lambda c: c.isin("marker", "verse-number") | c.startswith("iconPointer"))


def is_citation(node: Column) -> Column:
    return (node["name"] == "a") & has_class(node, "scripture-ref")


def empty() -> Column:
    return F.lit("")


def elements(nodes: Column, name: str = "", cls: str = "", where: Test | None = None) -> Column:
    """The elements of a list of nodes with the name, the class and the condition."""

    def wanted(n: Column) -> Column:
        good = (n["at"] > 0) & n["words"].isNull()
        good = good & (n["name"] == name) if name else good
        good = good & has_class(n, cls) if cls else good
        return good & where(n) if where else good

    return F.filter(nodes, wanted)


def within(nodes: Column, node: Column, itself: bool = False) -> Column:
    """What is inside a node, of the list of all nodes of its page."""
    return F.slice(nodes, node["at"] + (1 if itself else 2), node["last"] - node["at"] + (1 if itself else 0))


def is_inside(node: Column, outer: Column) -> Column:
    """Whether a node is inside one of a list."""
    return F.exists(outer, lambda o: (node["at"] > o["at"]) & (node["at"] <= o["last"]))


def inside(outer: Column, inner: Column) -> Column:
    """Those of inner that are inside one of outer, each once."""
    return let(outer, lambda o: F.filter(inner, lambda n: is_inside(n, o)))


def path(nodes: Column, *steps: tuple[str, str], below: Column | None = None) -> Column:
    """Elements reached by (name, class) steps, each anywhere inside the one before (the first inside one of `below`); each once."""
    found = below
    for step in steps:
        found = elements(nodes, *step) if found is None else inside(found, elements(nodes, *step))
    return found


def text_of(nodes: Column, node: Column, without: Test | None = None, since: Column | None = None) -> Column:
    """The text inside a node, white space collapsed; empty where there is none. without: elements whose text doesn't count,
    inside it or being it; since: the place from which text counts."""

    def counts(n: Column) -> Column:
        return n["words"].isNotNull() if since is None else n["words"].isNotNull() & (n["at"] >= since)

    texts = F.filter(within(nodes, node), counts)
    if without is not None:
        texts = let(elements(within(nodes, node, True), where=without), lambda out: F.filter(texts, lambda n: ~is_inside(n, out)))
    return normalize_whitespace(F.array_join(F.transform(texts, lambda n: n["words"]), ""))


def first_text(nodes: Column, found: Column) -> Column:
    """The text of the first of the elements; empty where there is none."""
    return F.coalesce(F.get(F.transform(F.slice(found, 1, 1), lambda n: text_of(nodes, n)), F.lit(0)), empty())


def last_text(nodes: Column, found: Column) -> Column:
    return first_text(nodes, F.reverse(found))


def texts_of(nodes: Column, found: Column) -> Column:
    """The texts of elements that have one."""
    return F.filter(F.transform(found, lambda n: text_of(nodes, n)), lambda t: t != "")


def first_of_page(name: str, cls: str = "", where: Test | None = None) -> Column:
    return first_text(F.col("nodes"), elements(F.col("nodes"), name, cls, where))


def content(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def _ascii_number(said: Column) -> Column:
    return F.coalesce(F.when(said.rlike("^[0-9]+$"), said).try_cast("int"), F.lit(0))


def _number_in(said: Column) -> Column:
    return F.coalesce(said.try_cast("int"), F.lit(0))


def notes(nodes: Column) -> Column:
    """Footnotes: structs of key, category, text, references."""

    def key(n: Column) -> Column:
        full, identity = attribute(n, "data-full-marker"), attribute(n, "id")
        return F.when(full != "", full).when(identity.startswith("note"), F.regexp_replace(identity, "^note", "")).otherwise("")

    def note(n: Column) -> Column:
        kinds = F.transform(elements(within(nodes, n, True), where=lambda x: attribute(x, "data-note-category") != ""), lambda x: attribute(x, "data-note-category"))
        links = texts_of(nodes, elements(within(nodes, n), "a", where=lambda x: attribute(x, "href").contains("/study/scriptures/")))
        return content(key=key(n), category=F.array_join(F.array_distinct(kinds), ", "), text=text_of(nodes, n, is_mark), references=F.array_distinct(links))

    return F.transform(elements(nodes, "li", where=lambda n: key(n) != ""), note)


def _markers(nodes: Column, node: Column, choose: Test) -> Column:
    """The markers of the superscripts in a node."""
    sups = F.transform(elements(within(nodes, node), "sup"), lambda s: content(marked=has_class(s, "marker"), said=text_of(nodes, s), value=attribute(s, "data-value")))
    return F.filter(let(sups, choose), lambda m: m != "")


def chapter(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    chosen = lambda s: F.when(F.exists(s, lambda x: x["marked"]), F.transform(F.filter(s, lambda x: x["marked"]), lambda x: x["said"])).otherwise(F.transform(s, lambda x: x["value"]))

    def verse(v: Column) -> Column:
        number = F.regexp_replace(first_text(nodes, elements(within(nodes, v), "", "verse-number")), r"\D", "")
        return content(number=_number_in(number), text=text_of(nodes, v, is_mark), footnote_markers=_markers(nodes, v, chosen))

    cited = F.transform(elements(nodes, "a", "study-note-ref"), lambda a: content(key=F.substring_index(attribute(a, "href"), "#note", -1), said=text_of(nodes, a, is_mark)))
    last_said = lambda c, n: F.coalesce(F.try_element_at(F.filter(c, lambda x: x["key"] == n["key"]), F.lit(-1))["said"], empty())
    foot = let(cited, lambda c: F.transform(notes(nodes), lambda n: content(key=n["key"], category=n["category"], text=n["text"], references=n["references"], reference_text=last_said(c, n))))
    dominant = first_text(nodes, path(nodes, ("h1", ""), ("span", "dominant")))
    book = F.coalesce(F.nullif(dominant, empty()), first_of_page("h1", where=lambda n: attribute(n, "id") == "title1"))
    number = _number_in(F.regexp_extract(first_of_page("", "title-number"), r"\d+", 0))
    verses = F.transform(elements(nodes, "p", "verse"), verse)
    return pages.select("page", content(book=book, chapter=number, summary=first_of_page("", "study-summary"), verses=verses, footnotes=foot).alias("content"))


def entry(pages: DataFrame, own: str = "TG") -> DataFrame:
    """Topic or index entry: its title; a row for each cross reference under the title and for each line (a phrase and all
    its citations as one reference)."""
    nodes = F.col("nodes")
    own_path = f"/scriptures/{'triple-index' if own == 'IDX' else 'tg'}/"

    def cross(link: Column) -> Column:
        href = attribute(link, "href")
        part = F.when(href.contains(own_path), own).when(href.contains("/scriptures/tg/"), "TG").when(href.contains("/scriptures/bd/"), "BD").otherwise("")
        kind = F.coalesce(F.nullif(first_text(nodes, elements(within(nodes, link), "small")), empty()), part)
        plain, named = text_of(nodes, link), text_of(nodes, link, lambda n: n["name"] == "small")
        return let(kind, lambda k: content(phrase=empty(), reference=F.when(k != "", k).otherwise(plain), key=F.when(k != "", named).otherwise("")))

    def line(n: Column) -> Column:
        cited = F.get(elements(within(nodes, n), where=is_citation), F.lit(0))["at"]
        begins = let(cited, lambda at: F.array_max(F.transform(F.filter(within(nodes, n), lambda x: x["words"].isNull() & (x["depth"] == n["depth"] + 1) & (x["at"] <= at)), lambda x: x["at"])))
        reference = let(F.coalesce(begins, F.lit(2**31 - 1)), lambda at: text_of(nodes, n, since=at))  # from the child on that holds the first citation
        phrase = text_of(nodes, n, is_citation)
        return content(phrase=F.regexp_replace(phrase, "[ ,;.()]+$", ""), reference=F.regexp_replace(reference, "[ .]+$", ""), key=empty())

    bodies = path(nodes, ("article", ""), ("div", "body-block"))
    titles, lines = inside(bodies, elements(nodes, "p", "title")), inside(bodies, elements(nodes, "p", "entry"))
    links = F.flatten(F.transform(titles, lambda n: elements(within(nodes, n), where=lambda x: is_citation(x) & x["attributes"]["href"].isNotNull())))
    rows = F.concat(F.transform(links, cross), F.transform(lines, line))
    return pages.select("page", content(title=first_text(nodes, path(nodes, ("article", ""), ("h1", ""))), entries=rows).alias("content"))


def index_entry(pages: DataFrame) -> DataFrame:
    return entry(pages, "IDX")


def dictionary(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    outward = lambda n: is_citation(n) & ~attribute(n, "href").contains("/scriptures/bd/") & ~attribute(n, "href").contains("/scriptures/tg/")
    body = F.coalesce(F.get(elements(nodes, "div", "body-block"), F.lit(0)), F.get(nodes, F.lit(0)))
    held = let(body, lambda b: within(nodes, b))
    parts = let(held, lambda h: content(text=F.array_join(texts_of(nodes, elements(h, "p")), "\n\n"), references=texts_of(nodes, elements(h, where=outward))))
    rows = pages.select("page", first_of_page("h1").alias("title"), parts.alias("parts"))
    return rows.select("page", F.struct("title", "parts.text", "parts.references").alias("content"))


def translation(pages: DataFrame) -> DataFrame:
    """Sections of a translation page, with what their header compares; those without verses and summary are dropped."""
    nodes = F.col("nodes")
    steps = {"heading": [("header", ""), ("h2", ""), ("strong", "")], "summary": [("header", ""), ("p", "study-intro")], "compare": [("header", ""), ("h2", ""), ("a", "scripture-ref")]}

    def verse(v: Column) -> Column:
        return content(number=_ascii_number(first_text(nodes, elements(within(nodes, v), "span", "verse-number"))), text=text_of(nodes, v, is_mark))

    def section(s: Column, reached: Column) -> Column:
        first = {k: first_text(nodes, inside(F.array(s), reached[k])) for k in steps}
        return content(**first, verses=F.transform(elements(within(nodes, s), "p", "verse"), verse))

    sections = path(nodes, ("article", ""), ("section", ""))
    reached = lambda all_of: content(**{k: path(nodes, *way, below=all_of) for k, way in steps.items()})
    made = let(sections, lambda all_of: let(reached(all_of), lambda r: F.transform(all_of, lambda s: section(s, r))))
    kept = F.filter(made, lambda s: (F.size(s["verses"]) > 0) | (s["summary"] != ""))
    return pages.select("page", content(title=first_of_page("h1"), sections=kept).alias("content"))


def talk(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    either = lambda s: F.transform(s, lambda x: F.coalesce(F.nullif(x["said"], empty()), x["value"]))
    paragraph = lambda p: content(id=attribute(p, "id"), text=text_of(nodes, p, is_mark), footnote_markers=_markers(nodes, p, either))
    paragraphs = F.filter(F.transform(elements(nodes, "p", where=lambda n: attribute(n, "id").rlike("^p[0-9]+$")), paragraph), lambda p: p["text"] != "")
    named = let(elements(nodes, "", "author-name"), lambda a: F.concat(F.filter(a, lambda n: n["name"] == "p"), F.filter(a, lambda n: n["name"] != "p")))
    speaker = F.regexp_replace(first_text(nodes, named), "^By ", "")
    made = content(title=first_of_page("h1"), speaker=speaker, role=first_of_page("p", "author-role"), kicker=first_of_page("p", "kicker"), paragraphs=paragraphs, footnotes=notes(nodes))
    return pages.select("page", made.alias("content"))


def sessions(pages: DataFrame) -> DataFrame:
    """Talks of a conference page by session; links to sessions are skipped, each talk once."""
    nodes = F.col("nodes")
    part = lambda href, i: F.regexp_extract(href, r"^/study/general-conference/(\d{4})/(\d{1,2})/([^/?#]+)", i)

    def is_talk(n: Column) -> Column:
        return let(part(attribute(n, "href"), 3), lambda slug: (slug != "") & ~slug.endswith("-session"))

    def links(block: Column) -> Column:
        named = first_text(nodes, elements(within(nodes, block), "p", "title"))
        return let(named, lambda s: F.transform(elements(within(nodes, block), "a", where=is_talk), lambda a: content(session=s, href=attribute(a, "href"), link=a)))

    def row(x: Column) -> Column:
        inner, href = within(nodes, x["link"]), x["href"]
        title = F.coalesce(F.nullif(first_text(nodes, elements(inner, "span")), empty()), first_text(nodes, elements(inner, "p")))
        speaker = last_text(nodes, elements(inner, "p"))
        said = let(content(title=title, speaker=speaker), lambda t: content(title=t["title"], speaker=F.when(t["speaker"] != t["title"], t["speaker"]).otherwise("")))
        return let(said, lambda t: content(
            session=x["session"], url=F.concat(F.lit(HOST), href), slug=part(href, 3), year=part(href, 1).cast("int"), month=part(href, 2).cast("int"), title=t["title"], speaker=t["speaker"],
        ))

    blocks = elements(nodes, "li", where=lambda n: attribute(n, "data-content-type") == "general-conference-session")
    every = F.flatten(F.transform(blocks, links))
    once = let(every, lambda e: let(F.transform(e, lambda x: x["href"]), lambda h: F.filter(e, lambda x, i: F.array_position(h, x["href"]) == i + 1)))
    return pages.select("page", F.transform(once, row).alias("content"))


KINDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "chapter": chapter, "entry": entry, "index_entry": index_entry, "dictionary": dictionary, "translation": translation, "talk": talk, "sessions": sessions,
}


def extract(pages: DataFrame, kind: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and content (a struct; for sessions an array of them) of each page, read as the given kind of page. Keys tell pages apart."""
    return KINDS[kind](page_nodes(pages, key, html)).select(F.col("page").alias(key), "content")


def entries(pages: DataFrame, kind: str = "entry", key: str = "page_id") -> DataFrame:
    """key, title and entries of topic ("entry") or index ("index_entry") pages: lines that begin with a chapter get the book of
    the line before."""
    made = extract(pages, kind, key)
    return made.select(key, "content.title", carry_book_prefix(F.col("content.entries")).alias("entries"))


def merged_titles(rows: DataFrame, order: str, append: bool) -> DataFrame:
    """title and entries of pages that share a title: all entries in page order (topics and index), or those of the last page (dictionary)."""
    grouped = rows.groupBy("title")
    if append:
        return grouped.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "entries"))), lambda x: x.entries)).alias("entries"))
    return grouped.agg(F.max_by("entries", order).alias("entries"))


def translations(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, book, comprises, compare, summary and verses of each section of translation pages; the chapter is the url's last part."""
    keyed = pages.select(F.struct(key, url).alias("quern_page"), "html")
    made = extract(keyed, "translation", "quern_page").select(f"quern_page.{key}", chapter_of_url(F.col(f"quern_page.{url}")).alias("page_chapter"), "content")
    parts = made.select(key, "page_chapter", F.posexplode("content.sections").alias("nth", "s"))
    heading = translation_heading(F.col("s.heading"), F.col("page_chapter"))
    return parts.select(key, "nth", heading["book"].alias("book"), heading["comprises"].alias("comprises"), "s.compare", "s.summary", "s.verses")
