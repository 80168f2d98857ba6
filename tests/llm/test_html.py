"""Main text on the test pages against a cut by regular expressions, and on hand-made layouts."""

import html as entities
import re

import numpy as np
import pytest

from meterload.llm import html as M

SCHEMA = "page_id long, url string, html string, text string"
LONG = "This paragraph is long enough to be told from the short lines of menus and the like, as articles have them."


def cut(page):
    """The article of a page of the test tables; its template has one article element."""
    start, end = page.find("<article>"), page.find("</article>")
    blocks = re.split(r"</?(?:p|h1|br)>", page[start + 9: end if end >= 0 else None])
    lines = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return " ".join(line for line in lines if line)


def test_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in M.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == cut(r.html) and got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(cut(r.html))


LAYOUTS = {
    "plain blocks": (
        f"<html><head><title>t</title><style>x</style></head><body><div id=header>Site</div><div class='nav menu'><a>1</a><a>2</a></div>"
        f"<div id=content><h2>Head</h2><p>{LONG}<p>Short.<p>{LONG} &eacute;&amp;&#33;</div>"
        f"<div class='sidebar'>{LONG}</div><div id='footer'>{LONG}</div></body></html>",
        f"Head {LONG} Short. {LONG} é&!"),
    "comments, forms and notices": (
        f"<body class='has-sidebar'><div class=cookie-notice>{LONG}</div><main><article><header><h1>T</h1></header><p>{LONG}</p>"
        f"<form><p>{LONG}</p></form><div class='ad-slot'>{LONG}</div><ul><li>one<li>two</ul><p>a\n\t b<br>c</p>"
        f"<section id='comments'><p>{LONG}</p></section></article></main><aside>{LONG}</aside><footer>{LONG}</footer>",
        f"T {LONG} one two a b c"),
    "inline marks join words": (f"<article><p>{LONG} <b>bo</b>ld <i>x</i></p></article>", f"{LONG} bold x"),
    "scripts with tags": (f"<script>var a='</p><p>{LONG}';</script><article><p>{LONG}</p></article>", LONG),
    "unclosed head and stray ends": (f"<head><title>t<body></p></div><div><p>{LONG}</span></div></b><p>{LONG}", f"{LONG} {LONG}"),
    "teasers beside the article": (
        f"<article><p>{LONG}</p><p>{LONG}</p></article><article><p>See also this.</p></article>", f"{LONG} {LONG}"),
    "no markup": ("just  text", "just text"),
    "a form around the whole page": (
        f"<body><form id=aspnetForm><div><a href=1>Home</a><a href=2>News</a><a href=3>Shop</a></div><div><h1>T</h1><p>{LONG}</p>"
        f"<p>Short.</p><p>{LONG}</p></div></form></body>", f"T {LONG} Short. {LONG}"),
    "a form beside the article": (f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG}</p></form>", f"T {LONG} {LONG}"),
    "a menu without a telling name": (
        f"<body><div class=x1><a>Home</a> <a>About us</a> <a>Contact</a></div><div class=x2><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>"
        f"<div class=x3><ul><li><a>Press</a><li><a>Jobs</a><li><a>Terms</a></ul></div></body>", f"T {LONG} {LONG}"),
    "a block of links inside the article": (
        f"<article><h1>T</h1><p>{LONG}</p><div class=q7><a>One more</a><a>Another</a><a>A third</a></div><p>{LONG} <a>link</a> end</p>"
        f"</article>", f"T {LONG} {LONG} link end"),
    "a telling name around the article": (
        "<body><div class=menu><a>1</a><a>2</a></div><div class='social-history'><h1>Title</h1>" + f"<p>{LONG}</p>" * 6 + "</div>"
        f"<p>Stray line</p></body>", "Title " + " ".join([LONG] * 6)),
    "an unclosed nav": (
        f"<body><nav><ul><li><a>Home</a><li><a>News</a><li><a>Shop</a></ul><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article></body>",
        f"T {LONG} {LONG}"),
    "more comments than article": (
        f"<article><h1>T</h1><p>{LONG}</p></article><section class=comments><h2>Replies</h2>" + f"<p>{LONG} reply</p>" * 9 + "</section>",
        f"T {LONG}"),
    "a single link is a line of the article": (f"<article><p>{LONG}</p><p><a>The source</a></p><p>{LONG}</p></article>", f"{LONG} The source {LONG}"),
    "hidden blocks": (f"<article><p>{LONG}</p><div style='display: none'>{LONG}</div><p hidden>{LONG}</p></article>", LONG),
    "names rule all out": (f"<div class=sidebar><p>{LONG}</p></div>", LONG),
    "blank": ("<html></html>", ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert M.main_text(page) == want


@pytest.mark.parametrize("n", [1, 5, 50, 500])
def test_lines_beside_the_body_stay_on_pages_of_any_length(n):
    body = f"<p>{LONG}</p>" * n
    text = " ".join([LONG] * n)
    lead, tail = "Lead " + LONG, "Tail " + LONG
    around = f"<h1>Title</h1><p>{lead}</p>%s<p>{tail}</p>"
    want = f"Title {lead} {text} {tail}"
    menu = "<div><a>1</a></div>" * 3
    assert M.main_text(f"{menu}<div id=content>{around % f'<div class=body>{body}</div>'}</div>{menu}") == want
    assert M.main_text(f"{menu}<main>{around % f'<article>{body}</article>'}</main>{menu}") == want
    assert M.main_text(f"{menu}<div id=content><h1>Title</h1><div class=body>{body}</div></div>{menu}") == f"Title {text}"
    parts = f"<article><p>{lead}</p>{body}</article><article><p>{tail}</p></article>"
    assert M.main_text(f"{menu}<main>{parts}</main>{menu}") == f"{lead} {text} {tail}"


def test_edges(spark):
    rows = [(None, None, None, None), (1, "u", "", "x"), (2, "u", LAYOUTS["plain blocks"][0], "x"), (2, "u", LAYOUTS["plain blocks"][0], "x"),
            (3, "u", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", "x"), (4, "u", "<" * 20_000, "x"),
            (5, "u", "<div>" * 3000 + LONG, "x")]
    got = sorted(M.extract(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.text) for r in got[:4]] == [
        (None, ""), (1, ""), (2, LAYOUTS["plain blocks"][1]), (2, LAYOUTS["plain blocks"][1])]
    assert got[4].n_chars == 20_000 * (len(LONG) + 1) - 1 and got[6].text == LONG
    assert M.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_smoothing_and_threshold():
    assert np.allclose(M.smoothed(np.full(9, 5.0)), 5)
    low, high = np.array([1.0, 2, 1, 2]), np.array([90.0, 120, 100])
    assert 2 < M.threshold(np.concatenate([low, high])) < 90
    assert M.threshold(high) == 0
