"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks of text at the tags that break lines. A block is described by its words and link density, by
those of its neighbours, and by what the elements around it say. A decision tree trained on the small labelled table
below tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

#: Elements whose text is never shown as text, and those that end a block.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas textarea select head title".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PHRASES = frozenset("p a b i u em strong span small font code cite q s sub sup mark abbr time label".split())
CONTAINERS = frozenset("article main body section div td table".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Words in class, id and role attributes that mark what isn't main text.
MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:nav\w*|menu\w*|footer|sidebar|side|aside|banner|ads?|adverts?|advertisement|promo|sponsor\w*|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|share|social|related|recommend\w*|comments?|reply|replies|disqus|breadcrumbs?|pagination|pager|widget|toolbar|masthead|search|login|complementary|contentinfo|navigation)(?:$|[\s_-])")
MAIN_MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:article\w*|post-?(?:body|content)|entry-?content|main-?content|story-?body)(?:$|[\s_-])")

# Quotes delimit a value only behind an equals sign; anywhere else they are characters like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?|[^>=])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>][^\s>]*)))?""")
_READ = frozenset("class id role hidden aria-hidden".split())
#: Longer attributes are read each time.
LONGEST_CACHED = 200

#: What a block is described by.
FEATURES = ("words", "links", "previous_words", "previous_links", "next_words", "next_links", "heading", "in_main", "marked", "page_has_main")

#: The labelled table: the blocks of pages in page order, as an annotator would note them: words, linked words, inside
#: the element of the main text, marked as something else by an element or a name, heading, and whether they are main text.
LABELLED_PAGES = (
    # articles with a menu, an advert and a footer
    ((1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (8, 0, 0, 1, 0, 0), (11, 0, 1, 0, 1, 1), (49, 0, 1, 0, 0, 1), (108, 0, 1, 0, 0, 1), (40, 0, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1), (7, 0, 1, 0, 0, 1), (48, 0, 1, 0, 0, 1), (12, 0, 0, 1, 0, 0)),
    ((1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (10, 0, 0, 1, 0, 0), (9, 0, 1, 0, 1, 1), (197, 0, 1, 0, 0, 1), (7, 0, 0, 1, 0, 0)),
    ((1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (10, 0, 0, 1, 0, 0), (11, 0, 1, 0, 1, 1), (11, 0, 1, 0, 0, 1), (5, 0, 1, 0, 0, 1), (34, 0, 1, 0, 0, 1), (52, 0, 1, 0, 0, 1), (6, 0, 1, 0, 0, 1), (21, 0, 1, 0, 0, 1), (9, 0, 1, 0, 0, 1), (10, 0, 1, 0, 0, 1), (10, 0, 0, 1, 0, 0)),
    ((2, 2, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (4, 0, 0, 1, 0, 0), (4, 0, 1, 0, 1, 1), (4, 0, 1, 0, 0, 1), (15, 0, 1, 0, 0, 1), (83, 0, 1, 0, 0, 1), (6, 0, 1, 0, 0, 1), (14, 0, 0, 1, 0, 0)),
    # a single paragraph, then comments of readers
    ((3, 3, 0, 1, 0, 0), (9, 0, 1, 0, 1, 1), (120, 4, 1, 0, 0, 1), (3, 0, 0, 1, 1, 0), (22, 0, 0, 1, 0, 0), (64, 0, 0, 1, 0, 0), (18, 0, 0, 1, 0, 0), (8, 5, 0, 1, 0, 0)),
    # lists, tables, links and captions inside the main text
    ((1, 1, 0, 1, 0, 0), (6, 0, 1, 0, 1, 1), (30, 6, 1, 0, 0, 1), (4, 4, 1, 0, 0, 1), (3, 3, 1, 0, 0, 1), (5, 2, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1), (1, 0, 1, 0, 0, 1), (90, 9, 1, 0, 0, 1), (9, 0, 1, 0, 0, 1), (26, 20, 0, 1, 0, 0)),
    # one-word lines, a closing line at the end of the page, links as the only content
    ((1, 1, 0, 1, 0, 0), (1, 0, 1, 0, 1, 1), (1, 0, 1, 0, 0, 1), (60, 0, 1, 0, 0, 1), (4, 0, 1, 0, 0, 1), (1, 0, 1, 0, 0, 1), (9, 0, 1, 0, 0, 1), (1, 0, 1, 0, 0, 1), (28, 0, 1, 0, 0, 1), (6, 0, 1, 0, 0, 1)),
    ((5, 5, 0, 1, 0, 0), (8, 8, 1, 0, 1, 1), (17, 14, 1, 0, 0, 1), (2, 2, 1, 0, 0, 1), (12, 12, 1, 0, 0, 1), (40, 0, 1, 0, 0, 1), (7, 7, 1, 0, 0, 1), (1, 1, 1, 0, 0, 1), (15, 0, 1, 0, 0, 1), (1, 1, 0, 1, 0, 0)),
    ((12, 0, 1, 0, 0, 1), (1, 0, 1, 0, 0, 1), (35, 1, 1, 0, 0, 1)),
    ((7, 0, 1, 0, 1, 1), (3, 0, 1, 0, 0, 1)),
    ((5, 0, 1, 0, 0, 1),),
    # boxes inside the main text: share bar, advert, sidebar, notice, form
    ((5, 0, 0, 1, 0, 0), (10, 0, 1, 0, 1, 1), (3, 3, 1, 1, 0, 0), (70, 0, 1, 0, 0, 1), (11, 0, 1, 1, 0, 0), (66, 2, 1, 0, 0, 1), (2, 0, 1, 1, 1, 0), (30, 0, 1, 1, 0, 0), (81, 0, 1, 0, 0, 1), (20, 0, 1, 1, 0, 0), (7, 0, 1, 1, 0, 0), (45, 0, 0, 1, 0, 0)),
    # a long sidebar and a notice around the main text, some of it not marked
    ((42, 3, 0, 1, 0, 0), (7, 0, 1, 0, 1, 1), (25, 0, 1, 0, 0, 1), (38, 0, 1, 0, 0, 1), (60, 0, 0, 0, 0, 0), (24, 12, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 0)),
    # no element says where the main text is: running text with short lines between, link lists around
    ((2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (9, 0, 0, 0, 1, 1), (55, 0, 0, 0, 0, 1), (31, 3, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1), (72, 0, 0, 0, 0, 1), (24, 0, 0, 0, 0, 1), (2, 2, 0, 0, 0, 0), (8, 7, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0)),
    ((6, 6, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (7, 0, 0, 0, 1, 1), (40, 2, 0, 0, 0, 1), (4, 0, 0, 0, 0, 1), (33, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1), (12, 12, 0, 0, 0, 0), (25, 20, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0), (11, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (90, 5, 0, 0, 0, 1), (5, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1), (61, 0, 0, 0, 0, 1), (5, 5, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (5, 5, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (15, 0, 0, 0, 1, 1), (120, 0, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (31, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0), (9, 0, 0, 0, 1, 1), (66, 0, 0, 0, 0, 1), (31, 0, 0, 0, 0, 1), (8, 0, 0, 0, 0, 1), (11, 0, 0, 0, 0, 1), (47, 0, 0, 0, 0, 1), (16, 0, 0, 0, 0, 0)),
    ((1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (5, 0, 0, 0, 0, 1), (14, 0, 0, 0, 0, 1), (57, 0, 0, 0, 0, 1), (13, 0, 0, 0, 0, 1), (36, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1), (5, 0, 0, 0, 0, 1), (11, 0, 0, 0, 0, 0)),
    # no main element either, but names on the rest
    ((4, 2, 0, 1, 0, 0), (50, 0, 0, 1, 0, 0), (8, 0, 0, 0, 1, 1), (44, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (58, 1, 0, 0, 0, 1), (35, 0, 0, 1, 0, 0), (120, 0, 0, 1, 0, 0), (9, 9, 0, 1, 0, 0)),
    # a page without main text
    ((1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (5, 4, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0)),
    ((3, 0, 0, 0, 0, 0),),
)
#: Blocks in a leaf at least.
LEAST = 2


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The features of each labelled block, and whether it is main text."""
    rows, labels = [], []
    for page in LABELLED_PAGES:
        blocks = [Block("", words, linked, bool(in_main), bool(marked), bool(heading)) for words, linked, in_main, marked, heading, _ in page]
        rows.append(described(blocks))
        labels += [block[-1] for block in page]
    return np.vstack(rows), np.array(labels, int)


@dataclass
class Tree:
    """A node of a decision tree; leaves have no feature."""

    value: int
    feature: int = -1
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def classify(self, rows: np.ndarray) -> np.ndarray:
        """The class of each row."""
        out = np.full(len(rows), self.value)
        if self.low is not None and self.high is not None and len(rows):
            below = rows[:, self.feature] <= self.limit
            out[below] = self.low.classify(rows[below])
            out[~below] = self.high.classify(rows[~below])
        return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Tree:
    """A tree of least Gini impurity; equal splits go to the earlier feature, thresholds lie between two values."""
    node = Tree(int(labels.mean() >= 0.5))
    if depth == 0 or labels.min() == labels.max():
        return node
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[:-1] + values[1:]) / 2:
            below = rows[:, feature] <= limit
            if min(below.sum(), (~below).sum()) < LEAST:
                continue
            impurity = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (below, ~below))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(limit))
    if best is None:
        return node
    _, node.feature, node.limit = best
    below = rows[:, node.feature] <= node.limit
    node.low, node.high = grow(rows[below], labels[below], depth - 1), grow(rows[~below], labels[~below], depth - 1)
    return node


@cache
def trained_tree() -> Tree:
    """The tree of the labelled table."""
    return grow(*labelled_table())


@dataclass
class Block:
    """Text between two breaks."""

    text: str
    words: int
    linked: int
    in_main: bool
    marked: bool
    heading: bool


@lru_cache(4096)
def _flags(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it holds main text, by its name and attributes."""
    attributes: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):  # values are passed over whole: what they hold are not attributes
        if (attribute := m[1].lower()) in _READ:
            attributes.setdefault(attribute, m[2] or m[3] or m[4] or "")
    said = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    marked = name not in ("html", "body") and bool(said and MARKS.search(said))
    unseen = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    return name in ASIDE or unseen or marked, name in MAIN or bool(said and MAIN_MARKS.search(said))


class _Page:
    """The state of a walk over a page's tags."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, boilerplate, main
        self.names: dict[str, int] = {}  # how many of a name are open
        self.run: list[str] = []
        self.linked: list[str] = []
        self.hidden = self.marked = self.main = self.headings = 0

    def text(self, text: str) -> None:
        """Text between tags."""
        if not self.hidden:
            if "&" in text:
                text = html.unescape(text)
            self.run.append(text)
            if self.names.get("a"):
                self.linked.append(text)

    def end_block(self) -> None:
        """What was gathered is a block."""
        words = "".join(self.run).split()
        if words:
            linked = len("".join(self.linked).split()) if self.linked else 0
            self.found.append(Block(" ".join(words), len(words), linked, self.main > 0, self.marked > 0, self.headings > 0))
        self.run, self.linked = [], []

    def count(self, tag: tuple[str, bool, bool], by: int) -> None:
        """An element opens or ends."""
        name, marked, main = tag
        self.names[name] = self.names.get(name, 0) + by
        if marked:
            self.marked += by
        if main:
            self.main += by
        if name in HIDDEN:
            self.hidden += by
        elif name in HEADINGS:
            self.headings += by

    def pop(self) -> None:
        """The innermost element ends."""
        self.count(self.open.pop(), -1)

    def start(self, name: str, rest: str) -> None:
        """A start tag. A slash at its end says nothing: only void elements have no content."""
        if name in BLOCKS:
            self.end_block()
            if self.names.get("p"):  # a paragraph ends where another block begins
                while self.open and self.open[-1][0] in PHRASES:
                    self.pop()
            if name == "li" and self.open and self.open[-1][0] == "li":
                self.pop()
        elif name == "a":  # links don't nest
            self.end("a")
        if name in VOID:
            return
        marked, main = (_flags if len(rest) <= LONGEST_CACHED else _flags.__wrapped__)(name, rest)
        if name == "header" and self.main and not rest:
            marked = False
        tag = (name, marked, main)
        self.open.append(tag)
        self.count(tag, 1)

    def end(self, name: str) -> None:
        """An end tag; one that would reach through its container from inside is ignored.

        What isn't open isn't looked for, and what is passed over is closed, so a page takes time in proportion to its tags.
        """
        if name in BLOCKS:
            self.end_block()
        if not self.names.get(name):
            return
        for at in range(len(self.open) - 1, -1, -1):
            inner = self.open[at][0]
            if inner == name:
                while len(self.open) > at:
                    self.pop()
                return
            if name not in BLOCKS and inner in CONTAINERS:
                return


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    state, at = _Page(), 0
    for token in _TOKEN.finditer(page):
        start, end = token.span()
        if start < at:
            continue
        if start > at:
            state.text(page[at:start])
        at = end
        slash, name, rest = token.groups()
        if name is None:
            if token[0].startswith("<![CDATA["):
                state.text(token[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if slash:
            state.end(name)
        elif name in RAW:
            if name in BLOCKS:
                state.end_block()
            close = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else len(page)
        else:
            state.start(name, rest.strip())
    if at < len(page):
        state.text(page[at:])
    state.end_block()
    return state.found


def described(blocks: list[Block]) -> np.ndarray:
    """The blocks' features, in the order of FEATURES."""
    own = np.array([(b.words, b.linked / b.words if b.words else 0.0) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    flags = np.array([(b.heading, b.in_main, b.marked) for b in blocks], float).reshape(-1, 3)
    has_main = np.full((len(blocks), 1), float(any(b.in_main for b in blocks)))
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], flags, has_main])


def main_text(page: str | None) -> str:
    """The main text of a page: its main blocks in order, one on a line."""
    blocks = blocks_of(page or "")
    chosen = trained_tree().classify(described(blocks)) if blocks else []
    return "\n".join(block.text for block, keep in zip(blocks, chosen, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars (code points).

    A null or empty page, and one without main text, gives an empty text. Unclosed tags, comments and scripts end with
    the page. A page of any length and depth is read as a whole, in time that grows with its tags. Null ids and urls
    stay; repeated rows are handled one by one; an empty table gives no rows; other columns are ignored, whatever their
    names. Where two splits of the tree's table are equally good, the earlier feature is taken.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
