"""HTML extraction by layout-aware rendering.

A tree builder reads the tags, closes elements whose end tag is implied (p, li, dt, dd, option, tr, td, th, thead, tbody,
tfoot) and ignores stray end tags; the visible part of the tree is then rendered as text: white space collapses except
in pre and textarea, blocks stand on lines of their own, paragraphs, headings, lists, tables and the like are set off by
a blank line, list items get a bullet or their number and are indented by depth, br breaks a line, and the cells of a
table stand in a grid of columns and rows, where colspan and rowspan hold; a cell of several lines (a list, paragraphs, a table)
keeps them, beside those of its neighbours. What stands in a table but in no cell or caption comes before the table, as in a browser.
Of input the value is shown, where its type shows one, and the placeholder where there is none, as of textarea; options of select, with
the labels of their groups, and the content of details as if they were opened. Items of an ordered list are numbered by start, reversed and
value. The content of xmp and plaintext is text as it stands. Of svg the
texts are shown, each set off by blanks, and of math all text. visibility is inherited: in a hidden element those that are visible
again are shown. Not visible: script, style, template, noscript, head but for its title (kept apart), comments, elements with
hidden or display:none (in style attributes; style sheets aren't read; what ARIA says concerns other readers), rp, a dialog that isn't open, alt texts; what a browser shows only
where it can't do better (content of iframe, noframes, noembed, object, audio, video, canvas); datalist; in svg what draws nothing by
itself (title, desc, metadata, defs, symbol, clipPath, mask, pattern, marker; use isn't followed) and in math annotations and mphantom.

Defined cases: null html is empty and gives empty text; an unclosed comment or raw element hides the rest, as in a browser; unclosed
elements end with the page; repeated rows and null ids give a row each; other columns are ignored. Elements may nest to any depth.
Time is linear in the page, but for the text of nested tables, which is laid out anew for each table around it, and the blanks that
indent nested lists, which are part of the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noframes noembed".split())
BLOCK = frozenset("address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tr ul blockquote caption thead tbody tfoot optgroup listing xmp plaintext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre listing xmp plaintext blockquote figure article section hr fieldset".split())
UNSEEN = frozenset("head title datalist object audio video canvas rp".split())
AS_IS = frozenset("pre listing xmp plaintext textarea".split())
#: The same within svg and math.
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask pattern marker".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: These hold plain HTML again; a tag of BREAKOUT elsewhere in svg or math ends it.
SVG_HOLDS_HTML = frozenset("foreignobject desc title".split())
MATH_HOLDS_HTML = frozenset("mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Types of input that show their value, and what those without one show.
VALUE_TYPES = frozenset("text search url tel email number date month week time datetime-local submit reset button".split())
LABELS = {"submit": "Submit", "reset": "Reset"}
PLACEHOLDER_TYPES = frozenset("text search url tel email password number".split())
#: The most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Elements that hold nothing but parts of a table, and those parts.
TABLE_FRAME = frozenset("table thead tbody tfoot tr colgroup".split())
TABLE_PART = (TABLE_FRAME | frozenset("td th caption col".split())) - {"table"}
#: An opening tag ends these open elements, up to the nearest of the fences.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption", "colgroup"), ("tr", "table")), "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
} | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)))
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing xmp plaintext section table ul li dt dd td th tr".split())
#: An end tag doesn't look for its element beyond these.
SCOPE = frozenset("table td th html".split())

TOKEN = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?])")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WHOLE = re.compile(r"[ \t\n\f]*([+-]?\d{1,9})", re.A)


class Element:
    """`inner` says what its content is: "" HTML, "svg" (strings are not drawn), "text" (of svg) or "math"; `unseen`: not laid out,
    with all its content; `shows`: its visibility, None where it is that of its parent."""

    __slots__ = ("attributes", "children", "inner", "name", "shows", "unseen")

    def __init__(self, name: str, attributes: dict[str, str], unseen: bool, inner: str = "", shows: bool | None = None):
        self.name, self.attributes, self.unseen, self.inner, self.shows, self.children = name, attributes, unseen, inner, shows, []


def _tag_end(page: str, at: int) -> int:
    """The place after the > that ends a tag; one within quotes doesn't."""
    end = page.find(">", at)
    if end < 0:
        return len(page) + 1
    if '"' not in (inside := page[at:end]) and "'" not in inside:
        return end + 1
    n, quote, after_equals = len(page), "", False
    while at < n:
        c = page[at]
        if quote:
            if c == quote:
                quote = ""
        elif c == ">":
            return at + 1
        elif c in "\"'" and after_equals:
            quote = c
        if not c.isspace():
            after_equals = c == "="
        at += 1
    return end + 1  # a quote that never closes: as if there were none


def _attributes(inside: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _is_hidden(name: str, attributes: dict[str, str]) -> bool:
    if name in UNSEEN or name == "dialog" and "open" not in attributes:
        return True
    if not attributes:
        return False
    shown = DISPLAY.findall(_style(attributes))  # the last one holds
    return "hidden" in attributes or bool(shown) and shown[-1].lower() == "none"


def _style(attributes: dict[str, str]) -> str:
    """The style attribute without its comments."""
    style = attributes.get("style", "")
    return COMMENT.sub(" ", style) if "/*" in style else style


def _visibility(attributes: dict[str, str], outer: str) -> bool | None:
    said = VISIBILITY.findall(_style(attributes))
    if not said and outer in ("svg", "text") and attributes.get("visibility") in ("visible", "hidden", "collapse"):
        said = [attributes["visibility"]]
    return said[-1].lower() == "visible" if said else None


def _value(attributes: dict[str, str]) -> str:
    """What an input shows."""
    kind = attributes.get("type", "text").strip().lower()
    value = attributes.get("value", LABELS.get(kind, ""))
    if kind in PLACEHOLDER_TYPES and not value:
        return attributes.get("placeholder", "")
    return value if kind in VALUE_TYPES else ""


def _number(attributes: dict[str, str], name: str) -> int | None:
    said = WHOLE.match(attributes.get(name, ""))
    return int(said[1]) if said else None


def _numbers(ol: Element) -> Iterator[int]:
    """The numbers of a list's items, in order."""
    items = [c for c in ol.children if not isinstance(c, str) and c.name == "li" and not c.unseen]
    step = -1 if "reversed" in ol.attributes else 1
    start = _number(ol.attributes, "start")
    at = start if start is not None else len(items) if step < 0 else 1
    for item in items:
        said = _number(item.attributes, "value")
        at = at if said is None else said
        yield at
        at += step


def _inner(name: str, outer: str) -> str:
    if name in ("svg", "math"):
        return name
    if outer in ("svg", "text"):
        return "" if name in SVG_HOLDS_HTML else "text" if name == "text" else outer
    return "" if name in MATH_HOLDS_HTML else outer


def _is_undrawn(name: str, attributes: dict[str, str], outer: str) -> bool:
    """Hidden by the rules of svg and math."""
    if outer == "math":
        return name in MATH_UNSEEN
    return name in SVG_UNSEEN or attributes.get("display") == "none"


def build_tree(page: str) -> Element:
    root = Element("html", {}, False)
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()

    def close_to(names: tuple[str, ...], fences: tuple[str, ...]) -> None:
        fence = last(*fences)
        found = [at[k] for x in names if (at := places.get(x)) and (k := bisect_right(at, fence)) < len(at)]
        if found:
            cut(min(found))

    def open_table() -> int:
        """The place of the table in which parts of it are awaited; 0 in cells, captions and outside of tables."""
        k = last("table")
        return k if k > last("td", "th", "caption") else 0

    def add(child: Element | str) -> None:
        top = stack[-1]
        if top.name in TABLE_FRAME and (k := open_table()):
            if isinstance(child, str):
                if not child.strip(" \t\n\f"):
                    return
            elif child.name in TABLE_PART:
                top.children.append(child)
                return
            stack[k - 1].children.insert(-1, child)  # the open table is the last child
        else:
            top.children.append(child)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        if stack[-1].inner and page.startswith("<![CDATA[", m.start()):
            end = page.find("]]>", m.end())
            add(page[m.start() + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:  # comment, doctype, processing instruction
            end = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        name, at = m[2].lower(), _tag_end(page, m.end())
        if m[1]:
            if name in {"p", "br"} and not places.get(name):
                add(Element(name, {}, False))
                continue
            k = last(name)
            if k and (name in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") or k >= last(*SCOPE)):
                cut(k)
            continue
        inside = page[m.end() : at - 1]
        attributes = _attributes(inside) if inside.strip(" /\n\t") else {}
        if stack[-1].inner and (name in BREAKOUT or name == "font" and attributes.keys() & {"color", "face", "size"}):
            while stack[-1].inner:
                cut(len(stack) - 1)
        if name in RAW:
            if stack[-1].inner and inside.endswith("/"):
                continue
            closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = _tag_end(page, closing.end()) if closing else n
            continue
        if name == "body" and len(stack) > 1:
            close_to(("head",), ())
        if name in ENDS_P:
            close_to(("p",), ("table", "td", "th", "ul", "ol", "li", "button", "blockquote", "div", "article", "section"))
        if name in IMPLIED:
            close_to(*IMPLIED[name])
        if name in TABLE_PART and open_table():
            cut(last(*TABLE_FRAME) + 1)
        if name == "table" and (k := open_table()):  # tables nest in cells and captions only
            cut(k)
        if name == "html" or name == "form" and stack[-1].name in TABLE_FRAME and open_table():
            continue
        outer = stack[-1].inner
        element = Element(name, attributes, _is_hidden(name, attributes) or bool(outer) and _is_undrawn(name, attributes, outer), _inner(name, outer), _visibility(attributes, outer) if attributes else None)
        add(element)
        if name in ("title", "textarea", "xmp", "plaintext") and not (outer and inside.endswith("/")):  # their content is text only
            closing = None if name == "plaintext" else re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            held = page[at : closing.start() if closing else n]
            element.children.append(html.unescape(held) if name in ("title", "textarea") else held)
            at = _tag_end(page, closing.end()) if closing else n
        elif name not in VOID and not inside.endswith("/") or name in ("div", "p", "span", "td", "li"):
            if name not in VOID:
                places.setdefault(name, []).append(len(stack))
                stack.append(element)
    return root


class _Page:
    """Lines so far; `gap` line ends are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank = 0, False

    def text(self, s: str, as_is: bool) -> None:
        if as_is:
            first, *rest = s.split("\n")
            self._put((" " if self.blank and self.line and not self.gap else "") + first)
            self.blank = False
            for x in rest:
                self.lines.append("".join(self.line).rstrip())
                self.line = []
                self._put(x)
            return
        if not s:
            return
        flat = SPACE.sub(" ", s)
        if flat == " ":
            self.blank = True
            return
        if flat[0] == " ":
            self.blank = True
        self._put(("" if self.gap or not self.line or not self.blank else " ") + flat.strip(" "))
        self.blank = flat[-1] == " "

    def _put(self, s: str) -> None:
        if not s:
            return
        if self.gap and (self.lines or self.line):
            self.lines.append("".join(self.line).rstrip())
            self.lines += [""] * (self.gap - 1)
            self.line = []
        self.gap = 0
        self.line.append(s)

    def edge(self, gap: int) -> None:
        if self.lines or self.line:
            self.gap = max(self.gap, gap)
        self.blank = False

    def newline(self) -> None:
        if self.gap == 0 and (self.line or self.lines):
            self.gap = 1
        elif self.gap == 1:
            self.gap = 2
        self.blank = False

    def done(self) -> str:
        return "\n".join([*self.lines, "".join(self.line).rstrip()]).strip("\n")


def _span(attributes: dict[str, str], name: str, most: int) -> int:
    said = re.match(r"[ \t\n\f]*\+?(\d{1,9})", attributes.get(name, ""), re.A)
    return min(int(said[1]), most) if said else 1


class _Grid:
    """Cells of a table: in a row each stands in the next column that no cell of a row above still takes."""

    def __init__(self):
        self.cells: list[tuple[int, int, int, list[str]]] = []  # row, column, columns, lines
        self.row, self.column, self.group = -1, 0, 0
        self.taken: dict[int, tuple[int, int]] = {}  # column: (row that is free again, group in which it counts)

    def new_row(self) -> None:
        self.row, self.column = self.row + 1, 0
        self.taken = {c: t for c, t in self.taken.items() if t[0] > self.row and t[1] == self.group}

    def new_group(self) -> None:
        """thead, tbody or tfoot begins or ends: cells don't span beyond."""
        self.group += 1

    def add(self, attributes: dict[str, str], text: str) -> None:
        wide, high = max(1, _span(attributes, "colspan", MOST_COLUMNS)), _span(attributes, "rowspan", MOST_ROWS) or MOST_ROWS
        while self.column in self.taken:
            self.column += 1
        self.cells.append((self.row, self.column, wide, text.split("\n") if text else []))
        if high > 1:
            self.taken |= dict.fromkeys(range(self.column, self.column + wide), (self.row + high, self.group))
        self.column += wide

    def text(self) -> str:
        columns = sorted({c for _, c, _, _ in self.cells})  # where cells begin
        place = {c: k for k, c in enumerate(columns)}
        widths = [0] * len(columns)
        size = [max(map(len, lines), default=0) for *_, lines in self.cells]
        for (_, c, wide, _), n in zip(self.cells, size, strict=True):
            if wide == 1:
                widths[place[c]] = max(widths[place[c]], n)
        for (_, c, wide, _), n in zip(self.cells, size, strict=True):
            if wide > 1:
                held = widths[place[c] : bisect_right(columns, c + wide - 1)]
                lacks = n - sum(held) - 2 * max(0, sum(w > 0 for w in held) - 1)
                widths[place[c]] += max(0, lacks)
        offsets, at = [], 0
        for w in widths:
            offsets.append(at)
            at += w + 2 * (w > 0)
        out: list[str] = []
        for _, cells in groupby(self.cells, key=lambda x: x[0]):
            row = list(cells)
            for k in range(max(len(lines) for *_, lines in row)):
                line = ""
                for _, c, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(offsets[place[c]]) + lines[k]
                out.append(line.rstrip())
        return "\n".join(x for x in out if x)


def _table(table: Element, shown: bool) -> Generator:
    """Captions, then the grid."""
    grid, captions = _Grid(), []

    def visit(node: Element, shown: bool, in_row: bool) -> Generator:
        for c in node.children:
            if isinstance(c, str) or c.unseen:
                continue
            sees = shown if c.shows is None else c.shows
            if c.name == "tr":
                grid.new_row()
                yield visit(c, sees, True)
                in_row = False
            elif c.name in ("td", "th"):
                if not in_row:
                    grid.new_row()
                    in_row = True
                grid.add(c.attributes, (yield _rendered(c, sees)))
            elif c.name in ("thead", "tbody", "tfoot"):
                grid.new_group()
                yield visit(c, sees, False)
                grid.new_group()
                in_row = False
            elif c.name == "caption":
                captions.append((yield _rendered(c, sees)))
            else:
                yield visit(c, sees, in_row)

    yield visit(table, shown, False)
    return "\n".join(x for x in (*captions, grid.text()) if x)


def _rendered(root: Element, shown: bool = True) -> Generator:
    page = _Page()

    def visit(node: Element, depth: int, as_is: bool, shown: bool) -> Generator:
        numbers = _numbers(node) if node.name == "ol" else iter(())
        for c in node.children:
            if isinstance(c, str):
                if node.inner != "svg" and shown:
                    page.text(c, as_is)
                continue
            if c.unseen:
                continue
            name, sees = c.name, shown if c.shows is None else c.shows
            if name == "br":
                page.newline()
            elif node.inner == "svg" and c.inner != "svg" or name in ("td", "th") and node.name != "table":  # text of svg, or a cell outside of any table
                page.text(" ", False)
                yield visit(c, depth, as_is, sees)
                page.text(" ", False)
            elif name == "input":
                if sees and (value := _value(c.attributes)):
                    page.text(f" {value} ", False)
            elif name == "table":
                page.edge(2)
                if made := (yield _table(c, sees)):
                    page.text(made, True)
                page.edge(2)
            elif name in BLOCK:
                gap = 1 if depth and name in ("ul", "ol", "menu", "p") else 2 if name in SPACED else 1
                page.edge(gap)
                if name == "li":
                    mark = f"{next(numbers)}." if node.name == "ol" else "-"
                    if sees:
                        page.text("  " * max(0, depth - 1) + mark + " ", True)
                        page.blank = False
                if name == "optgroup" and sees and c.attributes.get("label"):
                    page.text(c.attributes["label"], False)
                    page.edge(gap)
                yield visit(c, depth + (name in ("ul", "ol", "menu")), as_is or name in AS_IS, sees)
                page.edge(gap)
            elif name == "textarea" and not any(c.children):
                if sees and c.attributes.get("placeholder"):
                    page.text(f" {c.attributes['placeholder']} ", False)
            else:
                yield visit(c, depth, as_is or name in AS_IS, sees)

    yield visit(root, 0, False, shown)
    return page.done()


def render(root: Element) -> str:
    """The text of root. Each call of the walk is a generator on this stack, so that depth isn't bounded by Python's."""
    stack, value = [_rendered(root)], None
    while stack:
        try:
            called = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(called)
            value = None
    return value


def _title(node: Element) -> str:
    pending = [node]
    while pending:
        e = pending.pop()
        if e.name == "title":
            return SPACE.sub(" ", "".join(x for x in e.children if isinstance(x, str))).strip()
        pending += [c for c in reversed(e.children) if not isinstance(c, str) and c.name in ("head", "title", "html")]
    return ""


def page_text(page: str | None) -> tuple[str, str]:
    """(title, visible text)."""
    root = build_tree((page or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))
    return _title(root), render(root)


def _extract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        made = [page_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([t for t, _ in made], pa.string()), pa.array([t for _, t in made], pa.string())], ["page_id", "title", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, title and text (what a reader sees) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return rows.mapInArrow(_extract, "page_id long, title string, text string")
