"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered, over streamed parser events.

1. The standard library's HTMLParser streams events. Block elements cut the page into lines; each line knows its
   text, the number of tags in it, how much of it is links, and the elements that it stands in. Scripts, styles, controls
   and hidden elements give no lines. Forms, navigation, headers, footers, asides and elements whose class, id or role
   names a menu, advert, notice, sidebar or comments are voted out, and their lines go. The ratios overrule a vote: an
   element that holds at least half of the text in lines of high ratio, and an article, a main element or the page's
   first heading, stays (a form around the whole page, an unclosed nav, a telling class name around the article).
2. A line's text-to-tag ratio is its number of characters by its number of tags. Ratios are smoothed with a
   Gaussian, so short paragraphs between long ones rise and lone long lines fall, and two-means clustering of the
   smoothed ratios gives the threshold between content and the rest. A line is content if its ratio is above it, both
   smoothed and as it is.
3. The content region is the deepest container that holds all content lines; an article or main element that holds
   them settles it. Where it has no heading of first or second order, it grows to hold the last one of first order
   before the content. All lines of the region are the text: short paragraphs and headings belong to it. The length
   of the page does not matter.
4. Blocks of links go, whatever they are called: containers and lists of the region with LINKS links or more that make
   up most of their text, without a line of content.

White space inside a line becomes one space; lines are joined by one space, in page order. Character references are
decoded by the parser. Nothing else is dropped, and no length is cut off.

Defined cases: null or empty html, and pages without text, give an empty text. Unclosed and stray end tags are
tolerated: a `p` or `li` ends at the next one, an end tag closes what was left open inside it. A header inside an
article that has a heading is part of the article. Rows are independent; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import map_arrow

#: Smoothing: standard deviation in lines, and reach of the kernel.
SIGMA, REACH = 1.0, 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr ruby rb rt rp".split())
_SILENT = frozenset(
    "script style noscript template button select textarea iframe object svg canvas head audio video map datalist title".split())
_VOTED = frozenset("nav footer aside form menu dialog fieldset".split())
#: Links that make a block one of links, and their least share of its characters.
LINKS, LINK_SHARE = 3, 0.6
_LINK_BLOCKS = frozenset("div ul ol dl table section p center".split())
#: Elements that end an open one of the same kind (or of the kinds listed) without an end tag.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
         "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an open element of that kind stops.
_BOUND = frozenset("table ul ol dl td th div section article main body blockquote".split())
_CONTAINERS = frozenset("div section article main body html td table center blockquote".split())
_P_ENDERS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
    "section table ul".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies "
    "respond discussion pagination pager skip disclaimer copyright legal paywall".split())
#: Whole class names or ids; "post-header" and the like belong to an article.
_WHOLE = frozenset("header site-header page-header site-footer page-footer top-bar".split())
#: "has-sidebar" says how the element around everything is laid out.
_LAYOUT = frozenset("has with no without layout hide".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (
        value and name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
        for name, value in attrs)


def _named_out(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether class, id or role name something that is not the article."""
    if tag in ("html", "body", "main", "article"):
        return False
    for name, value in attrs:
        if value and name in ("class", "id"):
            for word in value.split():
                parts = _SPLIT_NAME.split(_CAMEL.sub("-", word).lower())
                if word.lower() in _WHOLE and not in_article:
                    return True
                if any(part in _NAMES for part in parts) and not any(part in _LAYOUT for part in parts):
                    return True
        elif value and name == "role" and value.strip().lower() in _ROLES:
            return True
    return False


@dataclass(frozen=True)
class Line:
    text: str
    tags: int
    path: tuple[int, ...]  # the numbers of the elements around it
    link_chars: int
    links: int


class _Lines(HTMLParser):
    """The lines of a page, and what its elements are."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, silent
        self.silent = 0
        self.by_tag: set[int] = set()  # voted out by their tag ...
        self.by_name: set[int] = set()  # ... or by what they are called
        self.articles: set[int] = set()
        self.containers: set[int] = set()
        self.link_blocks: set[int] = set()
        self.headings: dict[int, str] = {}
        self.count = 0
        self.parts: list[str] = []
        self.tags = self.link_chars = self.links = self.in_links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, tuple(n for _, n, _ in self.stack), min(self.link_chars, len(text)), self.links))
        self.parts, self.tags, self.link_chars, self.links = [], 0, 0, 0

    def pop(self) -> None:
        tag, _, silent = self.stack[-1]
        if tag not in _INLINE:
            self.flush()
        self.stack.pop()
        self.silent -= silent
        self.in_links -= tag == "a"

    def close_open(self, kinds: tuple[str, ...]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in kinds:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in _BOUND:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "body":
            self.close_open(("head",))
        elif tag in _ENDS:
            self.close_open(_ENDS[tag])
        elif tag in _P_ENDERS:
            self.close_open(("p",))
        if tag not in _INLINE:
            self.flush()
        if tag in _VOID:
            return
        self.count += 1
        in_article = any(t in ("article", "main") for t, _, _ in self.stack)
        if tag in _VOTED or (tag == "header" and not in_article):
            self.by_tag.add(self.count)
        elif _named_out(tag, attrs, in_article):
            self.by_name.add(self.count)
        for kinds, numbers in ((("article", "main"), self.articles), (_CONTAINERS, self.containers),
                               (_LINK_BLOCKS, self.link_blocks)):
            if tag in kinds:
                numbers.add(self.count)
        if tag in ("h1", "h2"):
            self.headings[self.count] = tag
        silent = tag in _SILENT or (tag not in ("html", "body") and _hidden(attrs))
        self.stack.append((tag, self.count, silent))
        self.silent += silent
        if tag == "a":
            self.in_links += 1
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                while len(self.stack) > at:
                    self.pop()
                return
            if tag in _INLINE and self.stack[at][0] in _BOUND:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_links > 0:
                self.link_chars += len(" ".join(data.split()))


def page_lines(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def _ratios(lines: list[Line]) -> np.ndarray:
    return np.array([len(line.text) / max(line.tags, 1) for line in lines])


def heeded_lines(parser: _Lines) -> list[Line]:
    """The lines that no vote takes away. If names take all away that tags leave, names are not heeded."""
    lines, voted = parser.lines, parser.by_tag | parser.by_name
    if not any(n in voted for line in lines for n in line.path):
        return lines
    ratios = _ratios(lines)
    border = threshold(smoothed(ratios))
    weights = [len(line.text) - line.link_chars if ratio >= border else 0 for line, ratio in zip(lines, ratios)]
    heading = next((n for kind in ("h1", "h2") for line in lines for n in line.path if parser.headings.get(n) == kind), None)
    held: dict[int, int] = {}
    main: set[int] = set()
    for line, weight in zip(lines, weights):
        signal = heading in line.path or any(n in parser.articles for n in line.path)
        for n in line.path:
            if n in voted:
                held[n] = held.get(n, 0) + weight
                if signal and (heading in line.path or any(m > n for m in line.path if m in parser.articles)):
                    main.add(n)
    overruled = {n for n, weight in held.items() if n in main and 2 * weight >= sum(weights)}
    for out in (voted - overruled, parser.by_tag - overruled):
        if kept := [line for line in lines if not any(n in out for n in line.path)]:
            return kept
    return []


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios after a Gaussian; the ends are reflected."""
    steps = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-steps ** 2 / (2 * SIGMA ** 2))
    return np.convolve(np.pad(ratios, REACH, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """The border of two clusters of the logarithms: two means, from the extremes."""
    logs = np.log1p(values)
    low, high = float(logs.min()), float(logs.max())
    if high - low < math.log(2):  # one cluster
        return 0.0
    while True:
        border = (low + high) / 2
        upper = logs >= border
        new = float(logs[~upper].mean()), float(logs[upper].mean())
        if new == (low, high):
            return math.expm1(border)
        low, high = new


def content_lines(lines: list[Line]) -> list[int]:
    """The places of the lines above the threshold."""
    ratios = _ratios(lines)
    smooth = smoothed(ratios)
    border = threshold(smooth)
    content = np.flatnonzero((smooth >= border) & (ratios >= border)).tolist()  # not what only its neighbours lift
    return content or np.flatnonzero(smooth >= border).tolist()


def region(parser: _Lines, lines: list[Line], content: list[int]) -> int | None:
    """Number of the element that is the content region; None for the whole page."""
    paths = [line.path for line in lines]
    chosen = _lowest(parser, [paths[i] for i in content])
    if not any(n in parser.headings for path in paths if chosen is None or chosen in path for n in path):
        title = next((path for path in reversed(paths[: content[0]])
                      if any(parser.headings.get(n) == "h1" for n in path)), None)
        if title:
            chosen = _lowest(parser, [title, *(paths[i] for i in content)])
    return chosen


def without_link_blocks(parser: _Lines, lines: list[Line], content: set[int]) -> list[Line]:
    """`lines` without those of blocks that are mostly links; `content` has the places of lines that make no such block."""
    held: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        for n in line.path:
            if n in parser.link_blocks:
                counts = held.setdefault(n, [0, 0, 0, 0])
                counts[0] += len(line.text)
                counts[1] += line.link_chars
                counts[2] += line.links
                counts[3] += i in content and 2 * line.link_chars < len(line.text)
    out = {n for n, (chars, link_chars, links, good) in held.items()
           if links >= LINKS and link_chars >= LINK_SHARE * chars and not good}
    return [line for line in lines if not any(n in out for n in line.path)]


def _lowest(parser: _Lines, paths: list[tuple[int, ...]]) -> int | None:
    """The deepest article or main, or else the deepest container, around all paths."""
    around = []
    for a, b in zip(min(paths), max(paths)):  # what the first and the last in order share, all share
        if a != b:
            break
        around.append(a)
    named = [n for n in around if n in parser.articles]
    held = [n for n in around if n in parser.containers]
    return (named or held or [None])[-1]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = page_lines(html)
    lines = heeded_lines(parser)
    if not lines:
        return ""
    content = content_lines(lines)
    number = region(parser, lines, content)
    wanted = {id(lines[i]) for i in content}
    inside = [line for line in lines if number is None or number in line.path]
    kept = without_link_blocks(parser, inside, {i for i, line in enumerate(inside) if id(line) in wanted})
    return " ".join(line.text for line in kept or inside)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    def one(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_arrow(rows, one, "page_id long, url string, text string, n_chars long")
