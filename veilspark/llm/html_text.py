"""Main-text extraction: flat text blocks, neighbour features, a small decision tree.

A page is cut into flat blocks at every block-level tag. Each block carries its word
count, link density and sentence ends, the word count and link density of its neighbours on both sides,
its place on the page, and what its elements say: whether they are an article, a
list item or a heading, or belong to an element for navigation, and whether the nearest element whose
class, id, role or label holds a hint word (sidebar, comments, ad, ...) is a part of the page beside
the article. Further features are whether a block stands in an article element and whether the page
has one, the share of its words that notices and menus use (cookie, copyright, reply, ...), and whether the
heading above it is made of such words. An element that holds the article itself (an article or main element, or the
first-rank heading where there is none of these) is a wrapper, whatever its names say: it is no hint
against what it holds, and neither are words behind has, with, no or without. A decision tree, grown by Gini
impurity on the labelled table below, keeps or drops each block. Script,
style and similar raw elements never become text; character references are decoded;
white space inside a block collapses to one space; kept blocks join by one space.

Edge cases. Null and blank html, and pages of which no block is kept, give an empty text. Unclosed and stray tags are
tolerated: a closing tag closes up to its nearest open match or nothing. Cut-off
tags and comments at the end end there. Pages may repeat; rows are independent. Columns of other names
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
HINTS = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead topbar toolbar cookie cookies consent "
    "notice gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget comment comments respond disqus reply replies copyright legal pagination pager skip tags".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAKS = HEADINGS | frozenset("p li dt dd tr td th option div section ul ol table header blockquote".split())
MAIN = frozenset("article main".split())
MAIN_HINTS = frozenset("article content post entry story body main text".split())
#: Words that make the hint behind them a property of a wrapper, not a name.
QUALIFIERS = frozenset("has have with no not without hide hidden show open close is".split())

#: Words of notices, menus and reader sections, as they stand in texts.
CUES = frozenset(
    "cookie cookies consent accept copyright © reserved rights privacy policy terms imprint impressum datenschutz agb mentions légales subscribe subscription newsletter unsubscribe login logout register sign signup "
    "advertisement advert anzeige publicité publicidad sponsored promo share tweet facebook twitter instagram whatsapp comment comments commented kommentar kommentare commentaires comentarios reply replies respond readers likes "
    "menu home contact about sitemap faq kontakt startseite accueil inicio related recommended trending".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_HINT_WORDS = re.compile(r"[a-z]+")
_CUE_WORDS = re.compile(r"[^\W\d_]+|©")
_SPACE = re.compile(r"\s+")

FEATURES = ("words", "link_density", "words_before", "words_after", "link_before", "link_after", "in_main", "outside", "hint_share", "main_hinted", "page_has_main", "heading", "list_item", "stops", "position", "in_article", "page_has_article", "cues", "under_cues")


@dataclass
class Block:
    """A flat text block; ``hint_share``: the share of the page's words in the hinted element it belongs to, 1 if none."""

    text: str
    words: int
    link_words: int
    main: bool = False
    outside: bool = False
    hint_share: float = 1.0
    main_hinted: bool = False
    heading: bool = False
    item: bool = False
    article: bool = False
    cues: float = 0.0


@dataclass
class Element:
    """An open element's facts; ``mark``: it or what it holds is the article."""

    name: str
    parent: int
    main: bool = False
    heading: bool = False
    item: bool = False
    hinted: bool = False
    main_hinted: bool = False
    aside: bool = False
    mark: bool = False
    article: bool = False
    words: int = 0


def said(attrs: str) -> tuple[bool, bool]:
    """(a hint against, a hint for) in the element's own names; qualified words count as neither."""
    against = favour = False
    for a in _ATTR.finditer(attrs):
        for name in (a.group(2) or a.group(3) or a.group(4) or "").lower().split():
            before = ""
            for w in _HINT_WORDS.findall(name):
                if before not in QUALIFIERS:
                    against |= w in HINTS
                    favour |= w in MAIN_HINTS
                before = w
    return against, favour and not against


def blocks(html: str) -> list[Block]:
    """The page's flat text blocks in order."""
    elements = [Element("", -1)]
    stack = [0]
    found: list[tuple[str, int, int, int]] = []  # text, words, link words, element
    pieces: list[str] = []
    linked: list[str] = []
    depth_a = 0
    at, n = 0, len(html)

    def text_out(raw: str) -> None:
        if raw:
            t = unescape(raw) if "&" in raw else raw
            pieces.append(t)
            if depth_a:
                linked.append(t)

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            words = len(text.split())
            if text:
                found.append((text, words, min(len(" ".join(linked).split()), words), stack[-1]))
            pieces.clear()
            linked.clear()

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text_out(html[at:])
            break
        text_out(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        closing, name, attrs = m.group(1), m.group(2).lower(), m.group(3) or ""
        if name == "br" or (name not in INLINE and name not in RAW):
            flush()
        if closing:
            if any(elements[e].name == name for e in stack[1:]):
                while len(stack) > 1:
                    e = elements[stack.pop()].name
                    depth_a -= e == "a"
                    if e == name:
                        break
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            continue  # on other elements a slash at the end says nothing
        # elements that end where a sibling begins
        if name in BREAKS or name in MAIN or name in OUTSIDE:
            while len(stack) > 1 and (elements[stack[-1]].name == "p" or elements[stack[-1]].name in INLINE or elements[stack[-1]].name in HEADINGS):
                depth_a -= elements[stack.pop()].name == "a"
        up = elements[stack[-1]]
        e = Element(name, stack[-1], up.main, name in HEADINGS, name in ("li", "dt", "dd", "option") or up.item, main_hinted=up.main_hinted)
        against = False
        if attrs and name not in ("html", "body"):
            against, favour = said(attrs)
            e.main_hinted |= favour
        e.article = up.article
        if name in MAIN and not (against and name == "article"):
            e.main = e.mark = True
            e.article |= name == "article"
        e.hinted = (against and name != "main") or bool(attrs and _HIDDEN.search(attrs))
        e.aside = name in OUTSIDE or (name == "header")
        stack.append(len(elements))
        elements.append(e)
        depth_a += name == "a"
    flush()
    return placed(elements, found)


def placed(elements: list[Element], found: list[tuple[str, int, int, int]]) -> list[Block]:
    """Blocks with what their elements say, once the whole page is known."""
    has_main = any(e.mark for e in elements)
    for e in elements:
        e.mark |= e.name == "h1" and (e.main or not has_main)
    for _, words, _, at in found:
        elements[at].words += words
    for e in reversed(elements[1:]):  # children follow their parents
        elements[e.parent].words += e.words
        elements[e.parent].mark |= e.mark
    total = max(elements[0].words, 1)
    outside, share = [False], [1.0]
    for e in elements[1:]:
        beside = not e.mark  # an element that holds the article is a wrapper
        outside.append(e.aside and beside or outside[e.parent])
        share.append(min(share[e.parent], e.words / total if e.hinted and beside else 1.0))
    return [Block(t, w, lw, elements[at].main, outside[at], share[at], elements[at].main_hinted, elements[at].heading, elements[at].item, elements[at].article, cue_share(t)) for t, w, lw, at in found]


def cue_share(text: str) -> float:
    """The share of a text's words that notices and menus use."""
    words = _CUE_WORDS.findall(text.lower())
    return sum(w in CUES for w in words) / max(1, len(words))


#: The cue words' share of a heading that speaks for what follows.
UNDER = 0.3


def features(page: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; the first and the last block are their own neighbours where none stands."""
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    density = np.array([b.link_words / max(b.words, 1) for b in page], float)
    words, density = np.pad(words, 1, mode="edge"), np.pad(density, 1, mode="edge")
    has_main, has_article, under = any(b.main for b in page), any(b.article for b in page), False
    for i, b in enumerate(page, 1):
        if b.heading:
            under = b.cues >= UNDER
        stops = sum(b.text.count(c) for c in ".!?")
        x[i - 1] = (
            words[i], density[i], words[i - 1], words[i + 1], density[i - 1], density[i + 1], b.main, b.outside, b.hint_share, b.main_hinted, has_main, b.heading, b.item,
            min(stops, b.words) / max(b.words, 1), i / n, b.article, has_article, b.cues, under,
        )
    return x


#: The labelled table: invented pages, a line per block in page order, judged by hand; a blank line ends a page.
#: Label (1: main text), words, link words, sentence ends, then letters for what holds: m in main, o outside, w main hint,
#: a in an article element (and so in main), t heading, l list item; then the share of the page's words in the hinted element around
#: the block (1 if there is none), and at last the share of cue words.
TABLE = """
0 2 2 0 ol
0 1 1 0 ol
0 1 1 0 ol
0 9 0 1 - .03
1 8 0 0 mt
1 74 0 5 m
1 3 0 1 m
1 120 6 8 m
1 41 0 3 m
0 16 2 1 o

0 4 2 0 o
0 1 1 0 -
0 2 2 0 -
0 1 1 0 -
0 2 2 0 -
1 7 0 0 t
1 55 4 4 -
1 80 0 6 -
1 12 0 1 -
1 96 11 7 -
0 5 5 0 -
0 6 6 0 -
0 5 5 0 -
0 8 2 0 -

0 3 3 0 l
0 1 1 0 l
0 2 2 0 l
1 5 0 0 wt
1 4 0 1 w
1 35 0 3 w
1 9 1 1 wl
1 14 2 1 wl
1 11 0 1 wl
1 62 7 4 w
0 30 4 2 - .12
0 11 8 0 - .12
0 9 1 1 -

0 1 1 0 mo
0 2 2 0 mol
0 3 3 0 mol
1 9 0 0 mt
1 22 0 2 m
1 30 3 2 ml
1 6 0 0 ml
1 17 17 0 m
1 88 40 4 m
0 5 5 0 ml
0 4 4 0 ml
0 6 6 0 ml
0 5 5 0 ml
0 3 0 0 mt .3
0 45 0 4 m .3
0 60 1 5 m .3
0 12 3 1 o

0 40 6 3 - .1
0 3 3 0 mol
0 2 2 0 mol
1 6 0 0 mwt
1 150 9 9 mw
1 2 0 0 mw
1 210 12 14 mw
0 7 0 1 mw .02
1 77 0 5 mw
0 24 20 0 mw .06
0 3 0 0 mwt .2
0 70 0 6 mw .2
0 19 3 2 o

0 6 6 0 -
0 7 5 0 -
1 19 1 1 -
1 210 10 12 -
1 44 0 3 -
0 3 3 0 -
0 2 2 0 -
0 7 4 0 -

1 11 0 0 t .97
1 67 3 5 - .97
1 5 0 1 - .97
1 134 0 9 - .97
0 2 2 0 -
0 4 3 0 -

0 8 0 0 ot
0 33 0 3 o
0 12 0 1 ol
1 4 0 0 mt
1 1 0 1 m
1 2 1 0 m
1 300 25 20 m
0 5 0 0 mot
0 20 12 1 mol
0 25 0 2 mo
0 90 0 7 m .35
0 14 0 1 m .35

0 2 2 0 -
0 3 3 0 -
0 3 3 0 -
1 4 0 0 t
1 16 0 2 -
1 9 0 1 -
1 3 0 0 t
1 21 2 2 -
0 10 10 0 l
0 9 9 0 l
0 12 12 0 l
0 4 0 0 o

0 28 2 2 - .15
0 2 2 0 ol
1 7 0 0 t
1 26 0 3 -
1 40 2 3 -
0 2 0 0 t .4
0 50 0 4 - .4
0 35 0 3 l .4
0 5 1 0 -

0 2 2 0 ol
0 1 1 0 ol
1 180 2 12 m
1 90 0 8 m
0 6 0 1 m .02
1 75 0 4 m
0 5 5 0 m .02
1 60 4 2 m
0 3 3 0 ol
1 1 0 0 m
1 130 0 7 m
0 2 2 0 o
0 60 0 4 o

0 7 7 0 o
1 140 0 9 m
0 40 30 2 o
0 3 3 0 o
1 2 0 0 m
1 3 0 1 m
0 30 0 2 - .1
0 1 1 0 ol
1 1 1 0 mt
1 250 0 20 m
0 18 0 2 o
0 15 0 1 o

0 12 0 1 - .03
0 3 3 0 ol
1 300 0 21 -
1 85 6 5 -
0 4 4 0 ol
0 30 0 2 o
1 160 0 9 -
0 20 0 2 - .05
1 95 0 6 -
0 70 0 4 o

0 1 1 0 -
1 110 0 6 -
0 2 2 0 -
1 65 3 4 l
0 3 3 0 -
1 140 50 8 -
0 9 8 0 -
1 70 0 5 -
0 80 0 5 - .15
1 58 0 4 -

0 90 70 1 o
0 2 2 0 ol
1 400 3 22 m
1 3 1 0 m
1 12 6 1 m
0 120 40 3 o
1 7 4 1 m
1 20 4 1 ml
1 33 8 2 m
0 70 30 2 - .1
0 1 1 0 ol
1 350 90 19 m
1 2 2 0 m
1 260 0 14 m
0 85 60 0 o
0 66 9 3 o

0 75 70 0 -
0 1 1 0 -
1 320 0 17 -
0 68 66 1 -
0 3 2 0 -
1 280 44 16 -
0 2 2 0 l
1 240 31 12 -
0 90 20 2 - .06
0 100 95 0 l

0 3 3 0 ol
1 5 5 0 m
1 20 0 2 m
1 6 6 0 m
1 15 0 1 m
1 4 4 0 m
1 30 1 2 m
1 8 7 0 m
0 4 4 0 o

0 4 0 0 - 1 .5
0 12 0 1 - 1 .25
1 8 0 0 at
1 90 4 6 a
1 60 0 4 a
1 25 9 1 a
1 2 0 0 at
1 5 5 0 al
1 6 6 0 al
1 7 7 0 al
0 9 0 1 - 1 .3
0 22 0 2 -
0 15 0 2 -
0 3 0 0 -

1 7 0 0 at
1 120 0 8 a
1 12 0 1 a 1 .2
1 3 0 1 a 1 .67
1 30 11 2 a

1 6 0 0 at
1 44 0 3 a
1 4 0 1 a 1 .5
1 61 2 4 a 1 .12
0 4 4 0 a 1 .75
1 3 0 1 a 1 .67

1 9 0 0 at
1 40 0 3 a
1 14 10 1 a
0 3 3 0 ol

1 2 0 0 mt
1 4 1 1 m
1 2 0 1 m
1 7 2 1 m
1 5 1 1 m

1 1 0 0 mwt
1 6 1 1 mw
1 3 0 1 mw

1 2 0 0 at
1 13 0 1 a
1 2 2 0 a
1 3 0 1 a
1 1 1 0 a
1 5 0 1 a

0 5 0 0 -
0 20 0 2 -
1 6 0 0 at
0 3 3 0 a .01 .6
1 85 2 6 a
0 8 8 0 al .1
1 70 0 5 a
1 12 12 0 a
0 30 0 3 -
0 140 0 9 -
0 40 0 3 -

1 11 0 0 at
1 66 0 4 a
1 9 9 0 al
1 8 8 0 al
0 3 0 0 at 1 .6
0 20 0 2 a
0 35 0 3 a
0 4 2 0 a

0 4 0 0 -
0 14 0 1 - 1 .2
1 7 0 0 t
1 80 0 5 -
1 64 3 4 -
1 3 0 1 -
1 75 0 5 -
0 8 0 1 - 1 .4
0 6 0 0 - 1 .5

0 5 0 0 - 1 .6
1 9 0 0 t
1 33 0 2 -
1 28 12 2 -

1 6 0 0 t
1 90 0 6 -
1 24 8 2 -
0 10 0 1 - 1 .3
0 7 7 0 -

0 6 0 0 - 1 .33
1 5 0 0 t
1 45 0 3 -
1 52 1 4 -
0 2 0 0 t 1 .5
0 18 0 2 -
0 25 0 2 -
0 5 0 1 -
0 31 0 3 -

0 16 0 1 - 1 .19
1 8 0 0 mt
1 58 0 4 m
1 22 9 1 m
0 7 0 0 mt 1 .4
0 33 0 3 m
0 12 0 1 m

1 2 0 0 t
1 3 0 1 -
1 40 0 3 -
1 3 0 1 -

1 6 0 0 at
1 70 0 5 a
1 1 0 0 at
1 6 6 0 al
1 6 6 0 al

1 5 0 0 t
1 31 0 2 -
1 2 0 1 -
1 64 0 5 -
1 4 0 1 -
0 3 3 0 -

1 10 0 0 wt
1 73 0 5 w
1 19 7 1 w
0 2 0 0 wt 1 1
0 28 0 2 w
0 11 0 1 - 1 .36
"""


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the labelled table's blocks, neighbours and places taken from its pages."""
    x, y = [], []
    for page in TABLE.strip().split("\n\n"):
        rows = []
        for line in page.splitlines():
            label, words, links, stops, what, *shares = line.split()
            share, cues, *_ = [*map(float, shares), *(1.0, 0.0)[len(shares) :]]
            rows.append(Block("." * int(stops), int(words), int(links), "m" in what or "a" in what, "o" in what, share, "w" in what, "t" in what, "l" in what, "a" in what, cues))
            y.append(int(label))
        x.append(features(rows))
    return np.concatenate(x), np.array(y)


@dataclass(frozen=True)
class Leaf:
    keep: bool


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


#: Columns in the order in which they win on equal gain.
ORDER = tuple(FEATURES.index(f) for f in ("link_density", "outside", "hint_share", "in_main", "words", "link_before", "link_after", "words_before", "words_after", "stops", "heading", "list_item", "main_hinted", "page_has_main", "cues", "under_cues", "in_article", "page_has_article"))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Leaf | Split:
    """A decision tree by Gini impurity."""
    if depth == 0 or y.min() == y.max():
        return Leaf(bool(2 * y.sum() >= len(y)))

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    best, found = impurity(y) - 1e-9, None
    for f in ORDER:
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = impurity(y[low]) + impurity(y[~low])
            if cost < best - 1e-12:
                best, found = cost, (f, at, low)
    if found is None:
        return Leaf(bool(2 * y.sum() >= len(y)))
    f, at, low = found
    return Split(f, float(at), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def train() -> Leaf | Split:
    return grow(*labelled_blocks())


def keeps(tree: Leaf | Split, row: np.ndarray) -> bool:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.keep


def extract(html: str | None, tree: Leaf | Split) -> str:
    """The page's main text."""
    page = blocks(html or "")
    if not page:
        return ""
    return " ".join(b.text for b, row in zip(page, features(page)) if keeps(tree, row))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars; one pass without a shuffle."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, tree) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
