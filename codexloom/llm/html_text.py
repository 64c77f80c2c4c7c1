"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block-level tags.  Each block has its number of
words and share of words in links, those of the block before and after it (inside the
article, of that), whether it is a heading, and what its enclosing elements say: an
element for navigation or notices, a class or id that names such a part, the article
(which may be a teaser beside the text).  A decision tree, grown when the module is used
on the small labelled table below, keeps or drops each block.

A class or id may also name the layout of a whole page: an element so marked counts as a
wrapper if the article is inside it, or the page's long blocks where there is no article.
Names that parts of an article have, too (``related-work``, ``section-header``), are only
a feature for the tree where they stand inside the article.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K

# Element names by their role in HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template textarea iframe svg title xmp noembed noframes".split())
#: What can stand in a head; anything else ends one that is still open.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
HIDDEN_TAGS = frozenset("head button select option input label".split())
BOILER_TAGS = frozenset("nav footer header aside form menu dialog fieldset".split())
#: Of these, the ones that may stand around a whole page, as a class or id may.
WRAPPER_TAGS = frozenset("form fieldset".split())
#: Words that a long block has, and the share of them in links, at most.
LONG = (25, 0.2)
#: An article element is a teaser where long blocks beside it, in no marked part, have more
#: than so many times its words.
TEASER = 3
ARTICLE_TAGS = frozenset("article main".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end when one of the same group begins beside them.
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|menu\w*|nav\w*|breadcrumb\w*|footer\w*|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|recommend\w*|widget\w*|comments?|comment-?(?:list|form|box|area|section|thread|author|body|content|item|wrap\w*)|respond|replies|disqus|copyright|legal|skip\w*|hidden|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
#: Names of other parts that parts of an article have as well.
WEAK_HINT = re.compile(r"(?:^|[\s_-])(?:header|foot|side|related|tags?)(?:$|[\s_-])", re.I)
ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|menu|dialog|alert)\b", re.I)
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# A quote opens a value only behind "=", and only if another one ends it; elsewhere it is a
# plain character.  No part gives characters back, so a tag is read once.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_ATTRIBUTES = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)""",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS}


class Block(NamedTuple):
    text: str
    words: int
    links: int  # words in links
    boiler: bool  # inside an element of a part that is never the article
    article: bool  # inside the article
    heading: bool
    mark: int  # the innermost of the marked elements around it, which may be wrappers of a page

    def long(self) -> bool:
        return self.words >= LONG[0] and self.links <= LONG[1] * self.words


class Mark(NamedTuple):
    """An element that a class, id, role or form marks; those around it by ``parent``."""

    parent: int
    depth: int  # marked elements with this one
    weak: bool  # inside the article, with a name that its own parts have, too


class _Open(NamedTuple):
    tag: str
    boiler: bool
    article: bool
    link: bool
    hidden: bool
    heading: bool
    mark: int


def _says(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element's own tag names another part; whether its class, id or role (or
    form) does, as a wrapper of a page may (1 for a name that an article's parts have, too,
    2 for others); whether it is hidden."""
    boiler, hint, hidden = tag in BOILER_TAGS - WRAPPER_TAGS, 2 * (tag in WRAPPER_TAGS), tag in HIDDEN_TAGS
    if attributes.strip():
        for name, *values in _ATTRIBUTES.findall(attributes):
            name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
            if name in ("class", "id"):
                hint = max(hint, 2 * bool(HINT.search(value)), bool(WEAK_HINT.search(value)))
            elif name == "role":
                hint = max(hint, 2 * bool(ROLE.search(value)))
            elif name == "style":
                hidden |= bool(HIDES.search(value))
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
    return boiler, hint, hidden


class _Stack:
    """The open elements.  Depths are kept by tag, of parts, and of blocks but paragraphs,
    so the nearest one is known without a walk, and each element is charged once, when it
    is taken off."""

    def __init__(self) -> None:
        self.open = [_Open("", False, False, False, False, False, 0)]
        self.by_tag: defaultdict[str, list[int]] = defaultdict(list)
        self.parts: list[int] = []
        self.blocks: list[int] = []

    def nearest(self, *tags: str) -> int:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=0)

    def push(self, element: _Open) -> None:
        depth, tag = len(self.open), element.tag
        self.open.append(element)
        self.by_tag[tag].append(depth)
        if tag in ARTICLE_TAGS or tag in BOILER_TAGS:
            self.parts.append(depth)
        if tag in BLOCK_TAGS and tag != "p":
            self.blocks.append(depth)

    def close(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.by_tag[element.tag].pop()
        del self.open[depth:]
        for depths in (self.parts, self.blocks):
            while depths and depths[-1] >= depth:
                depths.pop()

    def end(self, tag: str) -> None:
        """An end tag: of formatting, it doesn't reach out of a part."""
        depth = self.nearest(tag)
        if depth and (tag in BLOCK_TAGS or not self.parts or self.parts[-1] <= depth):
            self.close(depth)

    def make_room(self, tag: str) -> None:
        """Ends what can't hold the element that begins: one of its group beside it, or a
        paragraph, unless another block stands between."""
        if depth := self.nearest(*CLOSES.get(tag, ())) or (self.nearest("p") if tag in BLOCK_TAGS else 0):
            if not self.blocks or self.blocks[-1] <= depth:
                self.close(depth)


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The text blocks of a page, in order, and its marked elements (the first stands for none)."""
    out: list[Block] = []
    marks = [Mark(0, 0, False)]
    stack = _Stack()
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            # References are decoded over the whole block, links counted piece by piece.
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                top = stack.open[-1]
                linked = sum(len(html.unescape(t).split()) for t, link in parts if link)
                out.append(Block(text, len(text.split()), linked, top.boiler, top.article, top.heading, top.mark))
            parts.clear()

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if stack.open[-1].tag == "head" and piece.strip():
            stack.close(len(stack.open) - 1)
        if piece and not stack.open[-1].hidden:
            parts.append((piece, stack.open[-1].link))
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if stack.open[-1].tag == "head" and not closing and tag not in HEAD_TAGS:
            stack.close(len(stack.open) - 1)
        if tag == "svg" and attributes.endswith("/"):  # empty; HTML's own raw elements can't be
            continue
        if tag in RAW_TAGS and not closing:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            stack.end(tag)
            continue
        if tag in VOID_TAGS or attributes.rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        stack.make_room(tag)
        top = stack.open[-1]
        boiler, hint, hidden = _says(tag, attributes)
        if tag == "header" and top.article and not top.boiler:
            boiler = False  # an article's own heading, unless a hint says more
        if tag in ("body", "html", "article", "main"):
            boiler, hint = False, 0
        if hint:
            marks.append(Mark(top.mark, marks[top.mark].depth + 1, hint == 1 and top.article))
        mark = len(marks) - 1 if hint else top.mark
        article, link, heading = top.article or tag in ARTICLE_TAGS, top.link or tag == "a", top.heading or tag in HEADING_TAGS
        stack.push(_Open(tag, top.boiler or boiler, article, link, top.hidden or hidden, heading, mark))
    flush()
    return out, marks


#: Pages without an article element as their blocks stand: of each its words, those of them
#: in links, and whether it is main text.
PAGES = (
    # News: menu, crumbs, headline, byline, body, a list of links, footer.
    ((1, 1, 0), (1, 1, 0), (2, 2, 0), (1, 1, 0), (4, 3, 0), (9, 0, 1), (5, 0, 1), (62, 0, 1), (48, 3, 1), (71, 0, 1), (25, 5, 1), (55, 1, 1), (2, 2, 0), (8, 8, 0), (9, 9, 0), (7, 7, 0), (6, 0, 0), (3, 3, 0), (4, 4, 0)),
    # A blog entry with subheadings, a short list and a quotation.
    ((3, 3, 0), (1, 1, 0), (1, 1, 0), (7, 0, 1), (80, 2, 1), (4, 0, 1), (35, 0, 1), (6, 0, 1), (5, 0, 1), (8, 0, 1), (30, 0, 1), (130, 4, 1), (12, 0, 1), (44, 0, 1), (3, 3, 0), (5, 5, 0), (5, 0, 0), (2, 2, 0), (2, 2, 0)),
    # One long text between two menus.
    ((2, 2, 0), (2, 2, 0), (3, 0, 1), (300, 12, 1), (1, 1, 0), (1, 1, 0), (1, 1, 0)),
    # Texts right behind links, with and without a headline, and lines between links after them.
    ((4, 4, 0), (5, 5, 0), (60, 0, 1), (40, 1, 1), (5, 5, 0), (4, 0, 0), (6, 6, 0), (3, 0, 0), (4, 4, 0)),
    ((6, 6, 0), (8, 8, 0), (5, 0, 1), (50, 0, 1), (28, 0, 1), (10, 10, 0), (7, 0, 0), (1, 1, 0)),
    ((12, 12, 0), (2, 0, 1), (33, 4, 1), (90, 0, 1), (9, 9, 0), (4, 4, 0), (8, 0, 0)),
    ((1, 1, 0), (2, 2, 0), (24, 0, 1), (1, 1, 0), (3, 0, 0), (2, 2, 0)),
    ((7, 7, 0), (18, 0, 1), (16, 2, 1), (3, 0, 1)),
    ((1, 1, 0), (20, 0, 1), (3, 3, 0), (45, 2, 1), (2, 2, 0), (2, 0, 0), (1, 1, 0), (5, 0, 0)),
    ((3, 3, 0), (17, 1, 1), (9, 9, 0), (110, 6, 1), (14, 14, 0), (9, 0, 0), (11, 11, 0), (6, 0, 0)),
    # A directory: titles in links, each with a line about it; nothing of it is main text.
    ((1, 1, 0), (1, 1, 0), (3, 3, 0), (9, 2, 0), (4, 4, 0), (11, 3, 0), (3, 3, 0), (8, 2, 0), (5, 5, 0), (9, 0, 0), (1, 1, 0), (1, 1, 0)),
    # Long lists of links with a little between.
    ((40, 36, 0), (3, 0, 0), (20, 12, 0), (4, 3, 0), (60, 55, 0), (5, 4, 0), (4, 0, 0), (30, 28, 0)),
    # A text alone, of any size.
    ((45, 0, 1),),
    ((8, 0, 1), (30, 0, 1)),
    ((60, 0, 1), (2, 0, 1), (80, 0, 1), (14, 0, 1)),
    ((1, 0, 1),),
)
#: What the elements around a block say: inside a part named as boilerplate, inside the
#: article, the page has an article; and the label of any block there (None: its own).
PLACES = ((0, 0, 0, None), (0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 1, 0))


def articles(text: int, short: int, item: int, linked: float) -> list[list[tuple[int, ...]]]:
    """Articles with long blocks of ``text`` words and short ones, of whose words a share is
    in links, and link-only ones, as their blocks stand: of each its words, those of them in
    links, whether it is a heading, whether a name marks it that an article's parts have,
    too, and whether it is main text."""
    body, line = (text, int(linked * text), 0, 0, 1), (short, int(linked * short), 0, 0, 1)
    link, head = (item, item, 0, 0, 0), (short, 0, 1, 0, 1)
    marked = lambda block, main: (*block[:3], 1, main)
    return [
        # Headline, byline, text with subheads, short lines and one line that is a link.
        [head, line, body, head, body, line, line, (item, item, 0, 0, 1), line, body, body],
        [body], [line], [head, line], [line, line, body],
        # A list of links within the text, and at its end under a heading.
        [head, body, link, link, link, body, line, link, link],
        [head, body, body, head, link, link, link], [line, link, link, line, link, link, body],
        # Headings that are links.
        [(item, item, 1, 0, 1), line, body, (item, item, 1, 0, 1), body],
        # The article's own header, and headings and sections with such names.
        [marked(head, 1), marked(line, 1), body, marked(head, 1), body],
        [marked(head, 1), body, marked(head, 1), marked(body, 1), marked(line, 1), marked(body, 1)],
        [marked((short, 0, 1), 1), marked((item, item, 0), 0), marked((item, item, 0), 0), body],
        # Further reading: its heading, links, and lines about each of them; tags with a word before.
        [head, body, body, marked(head, 0), marked(link, 0), marked(link, 0), marked(link, 0)],
        [head, body, marked(head, 0), marked(link, 0), marked(line, 0), marked(link, 0), marked(line, 0), marked(link, 0)],
        [body, marked(line, 0), marked(link, 0), marked(link, 0)],
        [body, body, marked((1 + 4 * item, 4 * item, 0), 0)],
    ]


def shares(sizes: list[tuple[int, int]]) -> list[tuple[float, ...]]:
    """Words and share of words in links of the block before, of each block and of the block after."""
    own = [(0, 0.0), *((n, links / n if n else 0.0) for n, links in sizes), (0, 0.0)]
    return [(*own[k], *own[k + 1], *own[k + 2]) for k in range(len(sizes))]


#: The labelled table that the tree is grown on: the blocks of pages without an article, in
#: every place but inside one, and the blocks of articles of several sizes.
LABELLED = tuple(
    (*near, *place, 0, 0, own if label is None else label) for page in PAGES for near, (_, _, own) in zip(shares([b[:2] for b in page]), page, strict=True) for *place, label in PLACES
) + tuple(
    (*near, 0, 1, 1, *rest)
    for text in (26, 90, 300)
    for short in (1, 4, 12)
    for item in (1, 4, 15)
    for linked in (0, 0.05, 0.2, 0.5)
    for page in articles(text, short, item, linked)
    for near, (_, _, *rest) in zip(shares([b[:2] for b in page]), page, strict=True)
)


class DecisionTree:
    """Gini splits until leaves are pure, below a first one on the yes-or-no feature
    ``first``; ``nodes`` hold (feature, cut, left, right) or a label."""

    def __init__(self, table: np.ndarray, first: int) -> None:
        self.nodes: list[tuple] = []
        self._grow(table[:, :-1], table[:, -1], (first,))

    def _grow(self, x: np.ndarray, y: np.ndarray, features=None) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        best = None
        if 0 < y.mean() < 1:
            for f in features or range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    side = x[:, f] > cut
                    impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[side], y[~side]))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, cut, side)
        if best is None:
            self.nodes[at] = (float(y.mean()) >= 0.5,)
        else:
            _, f, cut, side = best
            left, right = self._grow(x[~side], y[~side]), self._grow(x[side], y[side])
            self.nodes[at] = (f, cut, left, right)
        return at

    def keep(self, features: tuple) -> bool:
        node = self.nodes[0]
        while len(node) == 4:
            f, cut, left, right = node
            node = self.nodes[right if features[f] > cut else left]
        return node[0]


def grown() -> DecisionTree:
    """The tree, whose first split is on whether the page has an article: labels of the one
    kind of page don't move the cuts for the other."""
    return DecisionTree(np.array(LABELLED, float), first=8)


def _beyond(marks: list[Mark], wrapper) -> list[int]:
    """Of each mark, what it and those around it say beyond the wrappers of the page: 0
    nothing, 1 a name that parts of an article have, too, 2 another part."""
    said = [0] * len(marks)
    for k, mark in enumerate(marks[1:], 1):  # a mark's parent comes before it
        said[k] = 0 if wrapper(k) else max(said[mark.parent], 1 if mark.weak else 2)
    return said


def placed(found: list[Block], marks: list[Mark]) -> list[tuple[bool, bool, bool]]:
    """(boilerplate, article, weakly marked) of each block.  A marked element is a wrapper of
    the page where the least marked articles are inside it, or, on a page without article,
    where the least marked long blocks are (of several elements, the one with the most words
    of them)."""
    articles = [b for b in found if b.article and not b.boiler]
    plain = [b for b in found if b.long() and not b.article and not b.boiler]
    least = min((marks[b.mark].depth for b in articles), default=0)
    if articles and TEASER * sum(b.words for b in articles) < sum(b.words for b in plain if not b.mark):
        found = [b._replace(boiler=b.boiler or b.article, article=False) for b in found]
        articles = []
    elif articles and least:  # not if more is said outside any marked element, as beside teasers
        inside = sum(b.words for b in articles if marks[b.mark].depth == least)
        if sum(b.words for b in plain if not b.mark) >= inside:
            articles = []
    if articles:
        inner, outer = _beyond(marks, lambda k: marks[k].depth <= least), _beyond(marks, lambda k: False)
        said = [(inner if b.article else outer)[b.mark] for b in found]
    else:
        words: dict[int, int] = {}
        for b in plain:
            words[b.mark] = words.get(b.mark, 0) + b.words
        at = min(words, key=lambda m: (marks[m].depth, -words[m]), default=0)
        around = {at}
        while at:
            at = marks[at].parent
            around.add(at)
        outer = _beyond(marks, around.__contains__)
        said = [2 * bool(outer[b.mark]) for b in found]
    return [(b.boiler or s == 2, b.article, s == 1) for b, s in zip(found, said, strict=True)]


def main_text(page: str | None, tree: DecisionTree) -> str:
    found, marks = blocks(page or "")
    place = placed(found, marks)
    inside = [article and not boiler for boiler, article, _ in place]
    sizes = [(b.words, b.links) for b in found]
    if any(inside):  # neighbours inside the article; nothing beside it is kept
        near = iter(shares([s for s, own in zip(sizes, inside, strict=True) if own]))
        features = [next(near) if own else (0, 0.0, *s, 0, 0.0) for s, own in zip(sizes, inside, strict=True)]
    else:
        features = shares(sizes)
    any_inside = any(inside)
    return " ".join(
        b.text
        for b, near, (boiler, article, weak), own in zip(found, features, place, inside, strict=True)
        if tree.keep((*near, boiler, article, any_inside, own and b.heading, own and weak))
    )


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text``, the main text, and ``n_chars``, its code points.

    Null and empty pages, and pages without main text, have the empty string; unclosed
    and stray tags, quotes and nested parts of any depth are tolerated, in time and memory
    that grow with the page; repeated rows each get
    their result; an empty table stays empty; input columns with the names of results are
    replaced, others stay.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*kept)
    tree = grown()

    def run(batches):
        for batch in batches:
            for piece in K.pieces(batch, html_col):
                texts = [main_text(p, tree) for p in piece.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"]
                )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``extract`` without the page itself."""
    return extract(pages, html_col).drop(F.col(html_col))
