import random
import re
import time

import pytest

from quern.llm import html_text as m

CASES = [
    ("", ""),
    (None, ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one <b>two</b>\n three<p>four<br>five", "one two three\n\nfour\nfive"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol start=4><li>q<li>r</ol></ul>z", "- x\n- y\n  4. q\n  5. r\n\nz"),
    ("<table><caption>cap</caption><tr><th>a<th>bb<tr><td>ccc<td>d</table>", "cap\na    bb\nccc  d"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide  x\n1  2  3"),
    ("<pre> keep\n  this </pre>after", " keep\n  this\n\nafter"),
    ("a<script>var t='</p>';</script>b<style>c</style><!-- d -->e<template>f</template>", "abe"),
    ("<div hidden>no</div><p style='DISPLAY : none'>no<p>yes<span aria-hidden=true> too</span>", "yes too"),
    ("<p style='/*display:none*/'>yes<p style='display:/* x */none'>no<p style='color:red/*'>open", "yes\n\nopen"),
    ("<input placeholder=find><input value=v placeholder=no><input type=password placeholder=word><input type=password value=x placeholder=no><input type=date placeholder=no>", "find v word"),
    ("<textarea placeholder=say></textarea> <textarea placeholder=no>said</textarea>", "say said"),
    ("<select><optgroup label=Birds><option>owl<option>jay</optgroup><option>other</select>", "Birds\nowl\njay\nother"),
    ("a<xmp><b>x</b> &amp;</xmp>b", "a\n\n<b>x</b> &amp;\n\nb"),
    ("a<plaintext><p>b</plaintext>", "a\n\n<p>b</plaintext>"),
    ("<listing>a\n  <b>b</b></listing>", "a\n  b"),
    ("<ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>", "kanji"),
    ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
    ("<ol reversed><li>a<li hidden>no<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=5>b<li>c</ol>", "10. a\n5. b\n4. c"),
    ("x <!-- never closed", "x"),
    ("<p>a</div></p>b</p>c", "a\n\nb\n\nc"),
    ("<a title='x > y'>link</a> <img alt=pic> 1 < 2 <3", "link 1 < 2 <3"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"),
    ("a<p></p><div> </div>b", "a\n\nb"),
    ("<head><title> T </title></head><body>b", "b"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert m.page_text(page)[1] == text


VISIBLE = [
    ("<table><p>note</p><tr><td>a</table>", "note\n\na"),
    ("<table><tr>loose<td>a</table>", "loose\n\na"),
    ("x<table>one <b>two</b><tbody>three<br>four<img alt=five><tr><td>a<td>b<tr>six<th>c</table>y", "xone twothree\nfoursix\n\na  b\nc\n\ny"),
    ("<table><caption>cap<tr hidden>loose<td>no<tr><td>a<table>in<tr><td>b</table>c</table>", "loose\n\ncap\nain\nb\nc"),
    ("<table><div>d<tr><td>a<table hidden>e<tr><td>no</table></table>f", "d\n\nae\n\nf"),
    ("<table><form>q<input value=no><tr><td>a<tr><td>b</form></table>", "q no\n\na\nb"),
    ("<table><colgroup>k<col><tr><td>a</table>", "k\n\na"),
    ("<p>If <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> then", "If x=12 then"),
    ("a<svg><title>no</title><style>no</style>no<g><text>b<tspan>c</tspan></text><text x=1>d</text><text display=none>no</text></g><path/></svg>e", "a bc d e"),
    ("<svg><foreignObject><div>a</div></foreignObject><text><![CDATA[b <i>]]></text><p>c", "a\nb <i>\n\nc"),
]


@pytest.mark.parametrize("page,text", VISIBLE)
def test_visible_text_of_tables_svg_and_math(page, text):
    assert m.page_text(page)[1] == text


SEEN = [
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>end", "yes\n\nend"),
    ("<div style='display:none'>no<p style='visibility:visible'>no</p></div>end", "end"),
    ("<p style='display:none;display:block'>yes<p style='x-visibility:hidden'>too", "yes\n\ntoo"),
    ("<form><input value=v><input type=submit><input type=submit value=Go><input type=hidden value=no><input type=password value=no><input type=checkbox value=no></form>", "v Submit Go"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<details><summary>s</summary>more</details>", "s\nmore"),
]
GRIDS = [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>1<td rowspan=3>x<td>2<tr><td>3<td>4<tr><td>5<td>6<tr><td>7<td>8</table>", "1  x  2\n3     4\n5     6\n7  8"),
    ("<table><thead><tr><th rowspan=0>h<th>i<tbody><tr><td>c<td>d</table>", "h  i\nc  d"),
    ("<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g</table>", "ab    c\n      d\ne  f  g"),
    ("<table><tr><td colspan=2>a rather wide one<td>x<tr><td>1<td>2<td>3</table>", "a rather wide one  x\n1               2  3"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>x<tr><td>longer<td>y</table>", "- a     x\n- b\nlonger  y"),
    ("<table><tr><td><p>a<p>b<td><p>c<p>d<p>e</table>", "a  c\nb  d\n   e"),
    ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>b<tr><td>1<td>2</table>", "   b\n1  2"),
    ("<table><tr><td colspan=99999999>a<td rowspan=x>b</table>", "a  b"),
]


@pytest.mark.parametrize("page,text", SEEN + GRIDS)
def test_visibility_and_grids(page, text):
    assert m.page_text(page)[1] == text


def random_page(rng, depth):
    """(HTML, words that are laid out and visible, in order)."""
    html, seen, words = [], [], []

    def word(shown):
        words.append(w := f"w{len(words)}")
        if shown:
            seen.append(w)
        return w + " "

    def node(depth, shown, laid_out):
        kind = rng.choice(["text", "text", "div", "span", "section", "list", "table", "none", "invisible", "visible", "comment", "raw"])
        if kind == "text" or depth == 0:
            html.append(word(shown and laid_out))
        elif kind == "comment":
            html.append("<!-- " + word(False) + "-->")
        elif kind == "raw":
            html.append("<script>" + word(False) + "</script>")
        elif kind == "list":
            html.append("<ul>")
            for _ in range(rng.randint(1, 3)):
                html.append("<li>")
                node(depth - 1, shown, laid_out)
            html.append("</ul>")
        elif kind == "table":
            html.append("<table>")
            if rng.random() < 0.3:
                html.append(word(shown and laid_out))  # in no cell
            for _ in range(rng.randint(1, 3)):
                html.append("<tr>")
                for _ in range(rng.randint(1, 3)):
                    html.append(f"<td colspan={rng.randint(1, 3)} rowspan={rng.randint(1, 3)}>")
                    node(depth - 1, shown, laid_out)
            html.append("</table>")
        else:
            tag, attribute = {"none": ("div", " hidden"), "invisible": ("div", " style='visibility: hidden'"), "visible": ("span", " style=visibility:visible")}.get(kind, (kind, ""))
            html.append(f"<{tag}{attribute}>")
            for _ in range(rng.randint(1, 3)):
                node(depth - 1, kind == "visible" or shown and kind != "invisible", laid_out and kind != "none")
            html.append(f"</{tag}>")

    for _ in range(3):
        node(depth, True, True)
    return "".join(html), seen


def test_all_visible_words_and_no_others():
    rng = random.Random(7)
    for _ in range(600):
        page, seen = random_page(rng, rng.randint(1, 6))
        got = re.findall(r"w\d+", m.page_text(page)[1])
        assert sorted(got) == sorted(seen), page
        if "<table" not in page:
            assert got == seen, page


def test_title():
    assert m.page_text("<html><head><title> A\n &lt;B </title><body>x")[0] == "A <B"
    assert m.page_text("<p>x")[0] == ""


def test_deep_and_odd_pages_end_soon():
    start = time.time()
    for page in ("<div>" * 50_000 + "x", "<table><tr><td>" * 5_000 + "x", "<b " + "a='" * 50_000, "<p" * 50_000, "</p>" * 20_000, "<ul><li>" * 3_000, "<!--" * 50_000, "&" * 200_000):
        m.page_text(page)
    assert time.time() - start < 30


@pytest.mark.parametrize("depth", [40, 119, 121, 3_000])
def test_text_of_deep_pages(depth):
    assert m.page_text("<table><tr><td>" * depth + "x")[1] == "x"
    assert m.page_text("<table><tr><td>" * depth + "x" + "</table>y" * depth)[1] == "\n".join(["x", *"y" * (depth - 1)]) + "\n\ny"
    assert m.page_text("<div>" * depth + "<div hidden>no</div>yes" + "</div>" * depth + "end")[1] == "yes\nend"
    assert m.page_text("<p>a" + "<b>" * depth + "<i>b</i>" + "</b>" * depth + "<div>c</div>d")[1] == "a" + "b\n\nc\nd"
    assert m.page_text("<ul><li>" * depth + "x")[1].split("\n")[-1] == "  " * (depth - 1) + "- x"


def test_query_over_a_table(spark):
    rows = [(1, "u", "<p>a", "t"), (None, None, None, None), (1, "u", "<p>a", "t"), (2, "u", "<b>x</b>" * 20_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in m.extract_text(df).collect()), key=str)
    assert got == sorted([(1, "", "a"), (None, "", ""), (1, "", "a"), (2, "", "x" * 20_000)], key=str)
    assert m.extract_text(df.limit(0)).count() == 0
