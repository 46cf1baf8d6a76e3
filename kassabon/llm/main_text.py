"""The main text of HTML pages.

A page is read once, tag by tag, into flat text blocks. Each block is described by its words and
link density, those of the blocks before and after it, and marks of the elements around it (what
their names, classes and roles say). A decision tree, grown from a small table of labelled blocks,
says which blocks are main text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, spans

#: Comments, declarations and tags; a quoted value may hold '>'. An unclosed comment or tag takes the rest.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: Elements whose content is not text of the page; they end at their end tag only.
RAW = frozenset("script style title textarea noscript iframe template xmp svg canvas object video audio button select datalist".split())
CLOSED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins ends an open one of these, up to the element that holds both.
ENDS = {t: frozenset({t}) for t in ("li", "option", "tr")} | {t: frozenset({"td", "th"}) for t in ("td", "th")} | {t: frozenset({"dd", "dt"}) for t in ("dd", "dt")}
HOLDS = {"li": frozenset("ul ol menu dir".split()), "option": frozenset({"select"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "th": frozenset({"tr", "table"}), "dd": frozenset({"dl"}), "dt": frozenset({"dl"})}

#: Marks of a block, from the elements around it.
ASIDE, WITHIN, HEAD, TITLE = 1, 2, 4, 8
ASIDE_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
WITHIN_TAGS = frozenset({"article", "main"})
#: Words of class, id and role. They say nothing on elements that hold the whole page.
ASIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs
    footer colophon copyright sidebar aside complementary contentinfo cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login
    form search share sharing social related recommended recommendations trending comment comments commentlist disqus respond replies pagination pager toolbar widget widgets skip""".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
WITHIN_WORDS = frozenset("article content main post entry story".split())
WHOLE = frozenset("html body main".split())
#: Before a word of a class, these turn its sense.
TURNED = frozenset("has with no without is".split())

#: Text that a task reads at a time.
AT_ONCE = 1 << 22


@dataclass
class Block:
    text: str
    words: int
    linked: int
    marks: int


@dataclass
class Reader:
    """The open elements, the marks of each, and the pieces of the block being read."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, int]] = field(default_factory=list)
    depth: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    marks: int | None = None

    def text(self, said: str) -> None:
        if not said:
            return
        said = unescape(said)
        self.pieces.append(said)
        if self.depth.get("a"):
            self.linked.append(said)
        if self.marks is None and not said.isspace():
            self.marks = self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            self.blocks.append(Block(" ".join(words), len(words), len("".join(self.linked).split()), self.marks or 0))
        self.pieces, self.linked, self.marks = [], [], None

    def close(self, tag: str) -> None:
        """Close the innermost open element of this name and all within it."""
        while self.open:
            name, _ = self.open.pop()
            self.depth[name] -= 1
            if name == tag:
                return

    def close_before(self, tag: str) -> None:
        """Close an open sibling that ``tag`` ends."""
        for name, _ in reversed(self.open):
            if name in ENDS[tag]:
                return self.close(name)
            if name in HOLDS[tag]:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.depth.get("p"):
                self.close("p")
            if tag in ENDS and self.depth.get(tag, 0) + sum(self.depth.get(t, 0) for t in ENDS[tag]):
                self.close_before(tag)
        if tag == "br":
            self.text("\n")
        if tag in VOID:
            return
        if tag == "a" and self.depth.get("a"):
            self.close("a")
        self.open.append((tag, marks_of(tag, attributes, self.open[-1][1] if self.open else 0)))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.depth.get(tag):
            self.close(tag)


def marks_of(tag: str, attributes: str, around: int) -> int:
    """Marks inside an element, from its name, class, id and role and the marks around it."""
    marks = around
    if tag in ASIDE_TAGS:
        marks |= ASIDE
    if tag in WITHIN_TAGS:
        marks |= WITHIN
    if tag in HEADINGS:
        marks |= TITLE
    if tag == "header":
        marks |= HEAD
    if attributes and tag not in WHOLE and "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for part in "".join(values).split():
                    said = [w.lower() for w in TOKEN.findall(part)]
                    if said and said[0] in TURNED:
                        continue
                    if not ASIDE_WORDS.isdisjoint(said):
                        marks |= ASIDE
                        continue
                    if not HEAD_WORDS.isdisjoint(said) and tag not in HEADINGS:
                        marks |= HEAD
                    if not WITHIN_WORDS.isdisjoint(said):
                        marks |= WITHIN
    return marks


def blocks(html: str) -> list[Block]:
    """Flat text blocks of a page, in page order: character references decoded, white space inside a block one space, trimmed."""
    reader, at = Reader(), 0
    while True:
        found = MARKUP.search(html, at)
        reader.text(html[at : found.start()] if found else html[at:])
        if not found:
            break
        at = found.end()
        if name := found[2]:
            tag = name.lower()
            if found[1]:
                reader.end(tag)
            elif tag not in RAW:
                reader.start(tag, found[3])
            elif not (tag == "svg" and found[3].endswith("/")):
                shut = CLOSED[tag].search(html, at)
                at = shut.end() if shut else len(html)
    reader.flush()
    return reader.blocks


FEATURES = "words words_before words_after links links_before links_after aside within head title page_within".split()


def described(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page. A block beyond the page has no words and no links."""
    out = np.zeros((len(found), len(FEATURES)))
    if not found:
        return out
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(min(b.linked, b.words) for b in found), 0], float) / np.maximum(words, 1)
    marks = np.array([b.marks for b in found])
    for i, column in enumerate((words, links)):
        out[:, 3 * i], out[:, 3 * i + 1], out[:, 3 * i + 2] = column[1:-1], column[:-2], column[2:]
    for i, mark in enumerate((ASIDE, WITHIN, HEAD, TITLE)):
        out[:, 6 + i] = (marks & mark) > 0
    out[:, 10] = (((marks & (WITHIN | ASIDE)) == WITHIN) * words[1:-1]).sum() > 0
    return out


#: The labelled table: layouts of pages, a block a word: kind, sizes in words, and + where it is main text.
#: Kinds: h heading, p paragraph, l list item that is a link, t list item of text, m paragraph with a link in it, c table cell.
#: An element around blocks is written name( ... ); .name is a division of that class.
LAYOUTS = """
nav( l1 l1 l1 ) .ad( p8 ) article( h6+ p60+ p4+ p1+ p30+ ) footer( p7 )
nav( l2 l1 l3 ) .ad( p12 ) article( h9+ p1+ p2+ p3+ p120+ ) footer( p9 )
header( h2 l1 l1 ) main( h5+ p40+ m25+ p6+ t5+ t9+ p50+ ) aside( h2 l4 l5 l3 p20 ) footer( p12 l1 l1 )
header( p3 ) article( header( h7+ p3 ) p70+ p20+ footer( p4 ) ) .comments( h1 p30 p12 p45 )
header( h3 ) article( header( h2+ p9 ) p35+ p5+ ) footer( p3 )
header( h1 p20 ) main( header( h1+ p6 p14 ) p3+ p50+ ) footer( h2 p6 )
header( h6 l1 ) article( header( p8 h12+ p1 ) p12+ p2+ ) footer( l2 )
.navbar( l1 l1 l1 l1 ) .content( h4+ p30+ p5+ m40+ p2+ ) .sidebar( h2 p25 l3 l4 ) .footer( p10 )
.cookie( p25 l1 ) .menu( l1 l2 l1 ) .post( h8+ p3+ p55+ t4+ t3+ t6+ p33+ ) .related( l7 l6 l8 ) .comment( p22 p40 )
.header( h3 p6 ) article( h6+ p45+ l1 l2 l2 l1 p38+ p2+ ) form( p4 p9 ) footer( p15 )
.header( h5 p2 p30 ) div( p25+ p3+ h2+ p60+ ) .footer( p6 )
article( h3+ p20+ l1+ p30+ l3+ p5+ l2+ p2+ ) footer( p5 )
article( p9+ l4+ p14+ l6+ p3+ l12 l9 l11 l7 p25+ l15+ p8+ )
main( l1 l2 l1 l1 h5+ p2+ l2+ p40+ l9+ h3+ p6+ l3 l3 l2 l4 l1 )
article( h2+ l5+ p60+ l8 l8 l6 l7 h2+ p15+ l2 l1 )
p30+ p45+ p12+ p60+ footer( p8 )
p2+ p1+ p3+
h1+ p1+ p5+ t2+ t1+ t3+ c1+ c2+
h5+ p50+ p6+ p80+ m30+ p4+ l1 l1 l1 l2
l1 l1 l2 h6+ p70+ p25+ p90+ l2 l1 l1
l1 l3 p3+ p2+ h1+ p1+ p8+ t3+ l4 l2 l1
h2+ p20+ l2+ p33+ l5+ p4+ footer( l2 p8 )
div( l2 l2 l1 ) div( h4+ p35+ p15+ p42+ t8+ t12+ ) div( l1 l1 l3 )
main( p20+ p1+ p1+ c2+ c3+ c1+ p30+ ) .newsletter( p18 )
article( h5+ p25+ p7+ m8+ p3+ t2+ t2+ t1+ ) .share( l1 l1 l1 ) .comments( article( p35 p6 ) )
nav( l1 ) p1+ footer( p3 )
nav( l1 l1 ) form( p3 p2 ) footer( p6 l1 )
.alert( p30 ) article( p100+ m60+ p5+ ) .promo( h3 p40 ) footer( p11 )
div( p14 ) main( h4+ p22+ p18+ l1+ p40+ ) div( p16 l2 l2 )
.sponsored( p60 m30 ) article( h8+ p2+ h3+ p31+ h2+ p16+ ) aside( p55 p48 )
header( h4 p12 p30 ) article( p4+ p2+ p9+ ) footer( p40 p22 )
div( p9 p30 ) article( h3+ p26+ p11+ p3+ ) div( p35 p8 h2 )
.main( h2+ p8+ p2+ p1+ c4+ c6+ ) .widget( p9 l2 )
""".strip().split("\n")
#: Copies of the labelled table with sizes varied by up to a half.
VARIED = 4


def layout_page(layout: str, vary: random.Random) -> tuple[str, list[bool]]:
    """The page of a layout, and whether each of its blocks is main text."""
    html, labels, shut = [], [], []
    shapes = {"h": "<h2>{}</h2>", "p": "<p>{}</p>", "l": "<li><a href='#'>{}</a></li>", "t": "<li>{}</li>", "m": "<p>{} <a href='#'>more</a></p>", "c": "<td>{}</td>"}
    for item in layout.split():
        if item == ")":
            html.append(shut.pop())
        elif item.endswith("("):
            name = item[:-1]
            html.append(f'<div class="{name[1:]}">' if name[0] == "." else f"<{name}>")
            shut.append("</div>" if name[0] == "." else f"</{name}>")
        else:
            size = int(item[1:].rstrip("+"))
            html.append(shapes[item[0]].format(" ".join(["word"] * max(1, round(size * vary.uniform(0.5, 1.5))))))
            labels.append(item.endswith("+"))
    return f"<body>{''.join(html)}</body>", labels


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: described blocks and their labels."""
    vary, rows, labels = random.Random(12), [], []
    for layout in LAYOUTS * VARIED:
        html, wanted = layout_page(layout, vary)
        rows.append(described(blocks(html)))
        labels += wanted
    return np.concatenate(rows), np.array(labels)


@dataclass
class Tree:
    """Nodes of a grown tree: a feature below its limit goes left; a leaf has feature -1 and its share of main text as limit."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def share(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while len(rows):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            node = at[i]
            at[i] = np.where(rows[i, self.feature[node]] < self.limit[node], self.left[node], self.right[node])
        return self.limit[at]


def grown(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 3) -> Tree:
    """A decision tree by Gini impurity; ties go to the feature that comes first, then to the smaller limit."""
    nodes: list[list[float]] = []

    def grow(own: np.ndarray, deep: int) -> int:
        at, y = len(nodes), labels[own]
        nodes.append([-1, float(y.mean()), 0, 0])
        if deep == depth or len(own) < 2 * least or y.min() == y.max():
            return at
        best = (float(len(own) * y.mean() * (1 - y.mean())) - 1e-9, -1, 0.0)
        for f in range(rows.shape[1]):
            order = np.argsort(rows[own, f], kind="stable")
            x, ones = rows[own, f][order], np.cumsum(y[order])
            n = np.arange(1, len(own))
            may = (x[1:] > x[:-1]) & (n >= least) & (len(own) - n >= least)
            if may.any():
                l, r = ones[:-1], ones[-1] - ones[:-1]
                cost = np.where(may, l * (1 - l / n) + r * (1 - r / (len(own) - n)), np.inf)
                i = int(cost.argmin())
                if cost[i] < best[0] - 1e-9:
                    best = (float(cost[i]), f, float((x[i] + x[i + 1]) / 2))
        if best[1] >= 0:
            nodes[at][:2] = best[1], best[2]
            left = rows[own, best[1]] < best[2]
            nodes[at][2] = grow(own[left], deep + 1)
            nodes[at][3] = grow(own[~left], deep + 1)
        return at

    grow(np.arange(len(rows)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int))


def texts(pages: list[str], tree: Tree) -> list[str]:
    """Main text of each page: its blocks that the tree takes, joined by line feeds."""
    found = [blocks(p) for p in pages]
    if not any(found):
        return [""] * len(pages)
    taken = tree.share(np.concatenate([described(f) for f in found])) >= 0.5
    out, at = [], 0
    for f in found:
        out.append("\n".join(b.text for b, t in zip(f, taken[at : at + len(f)], strict=True) if t))
        at += len(f)
    return out


def extracted(pages: DataFrame, html: str = "html", out: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` with a column ``out`` that holds the main text of the whole ``html``; a column of that name is replaced.

    A null or empty page, and one without main text, gives an empty string. Other columns, and repeated rows, stay.
    """
    ship(pages.sparkSession)
    tree = tree or grown(*labelled())

    @F.pandas_udf("string")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            given, got = part.fillna("").tolist(), []
            for first, last in spans(list(map(len, given)), AT_ONCE):
                got += texts(given[first:last], tree)
            yield pd.Series(got, dtype=object)

    return pages.withColumn(out, told(F.col(html).cast("string")))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every page."""
    got = extracted(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
