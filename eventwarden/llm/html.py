"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes text blocks in page order, each with its open elements. A small linear classifier says how much a block
looks like article text; its output is the block's capacity to the source (text) or the sink (boilerplate). Neighbouring
blocks, and blocks that follow each other in one element, are joined by smoothness edges that weaken with the distance
between them in the document tree. The minimum cut labels all blocks at once.

Only elements that are boilerplate by their meaning (menus, footers, asides, dialogs, hidden ones) settle a block. Names of
classes and ids add a bounded cost that fades on the way down; names that deny (``has-``, ``no-``, ``-free``) say nothing, and
neither does the name of an element that holds most of the page's words while no other text rivals it: then it is the
page's own wrapper. The same holds for forms.

Defined results: null and empty pages give the empty text. Pages are read whole and leniently: unclosed elements, cut
tags, stray ends, unclosed comments. Scripts, styles and the like run to their end tag or the end of the page, as browsers
read them; any other unread element without an end tag hides nothing. Rows are independent; other columns pass through,
but those named ``text`` or ``n_chars`` give way to the computed ones.
"""

from __future__ import annotations

import re
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from eventwarden.llm.jobs import LONG, STRING, field, map_texts, prepared
from eventwarden.llm.mincut import source_side

# fixed values: elements by role
BREAKING = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p
pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
UNREAD = RAW | frozenset("""noscript template iframe select option button object audio video canvas map annotation
annotation-xml metadata desc""".split())
OUTER = frozenset("nav footer aside menu dialog search".split())
INNER = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DENYING = frozenset("has have no not non without with hide is in".split())
OUTER_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo
promoted promotion sidebar sidenav nav navbar navigation navi menu menubar topnav breadcrumb breadcrumbs footer foot masthead
cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay newsletter subscribe subscription
signup signin login register social share sharing sharer related recommended recommendations trending popular comment
comments commentlist disqus reply replies respond discussion feedback widget toolbar pagination pager search form skip
copyright legal hidden""".split())
LESSER_NAMES = frozenset("header head top meta byline tags tag toc alert info bar teaser".split())
INNER_NAMES = frozenset("article content main post entry story text body prose markdown".split())
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

# fixed values: weights of the classifier and of the edges
OUTSIDE = -40.0
IN_ARTICLE = 3.5
BESIDE_ARTICLE = -3.0
GOOD_NAME = 1.5
LESSER_NAME = -1.2
OUTER_NAME = -5.0
FORM = -5.0
HEADER = -0.5
FADING = 0.8
LEAST_LEAN = -8.0
PARAGRAPH = 0.8
HEADING = 0.3
PER_LOG_WORD = 0.9
BASE = -2.0
LINKS = -4.5
NEIGHBOURS = 1.6
SIBLINGS = 0.8
FAR_APART = 64
# of the page's words: what a wrapper holds at least, and what text elsewhere needs to rival it
WRAPPER, RIVAL = 0.5, 0.2
RIVAL_WORDS = 12

ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TAG_END = re.compile(r"""(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
CLOSERS = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in UNREAD}


class Element:
    """An open element: what its tag and names say, and after the whole page has been read, what that means for a block."""

    __slots__ = ("tag", "depth", "parent", "words", "outside", "article", "named", "form", "lean")

    def __init__(self, tag: str, parent: "Element | None", attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.words = 0
        self.outside, self.article, self.form = tag in OUTER, tag in INNER, tag == "form"
        self.named, self.lean = False, HEADER if tag == "header" else 0.0
        if attributes:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        names: set[str] = set()
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for name in value.split():
                    pieces = [p.lower() for p in PIECES.findall(name)]
                    if pieces and pieces[0] not in DENYING and pieces[-1] != "free":
                        names.update(pieces)
            elif key == "role":
                self.outside |= value.lower() in OUTER_ROLES
                self.article |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                self.outside = True
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                self.outside = True
            elif key == "itemprop" and value.lower() == "articlebody":
                self.article = True
        if self.tag in ("html", "body"):
            return  # page-wide names say nothing about a block
        self.named = bool(names & OUTER_NAMES)
        if names & INNER_NAMES and not self.named:
            self.lean += GOOD_NAME
        elif names & LESSER_NAMES:
            self.lean += LESSER_NAME


def settle(elements: list[Element], blocks: "list[Block]") -> None:
    """Pass what the elements say down to the blocks, once the words of each are known. Parents come first in the list."""
    for block in blocks:
        block.element.words += block.words
    for element in reversed(elements):
        if element.parent:
            element.parent.words += element.words
    outer = lambda e: e.named or e.form
    # words of longer blocks under no outer name at all: what rivals a wrapper
    clear: dict[int, bool] = {}
    for element in elements:
        clear[id(element)] = not (outer(element) or element.outside) and (element.parent is None or clear[id(element.parent)])
    rival = sum(b.words for b in blocks if b.words >= RIVAL_WORDS and 2 * b.linked < len(b.text) and clear[id(b.element)])
    whole = sum(b.words for b in blocks)
    for element in elements:
        above = element.parent
        wrapper = outer(element) and element.words >= WRAPPER * whole and rival < RIVAL * whole
        if above:
            element.outside |= above.outside
            element.lean += above.lean * FADING
        if outer(element) and not wrapper:
            element.lean += OUTER_NAME if element.named else FORM
            element.article = False
        elif above:
            element.article |= above.article
        element.lean = max(element.lean, LEAST_LEAN)


class Block:
    __slots__ = ("text", "element", "linked", "words")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked, self.words = text, element, linked, text.count(" ") + 1


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: white space as one space, character references decoded, ends trimmed."""
    blocks: list[Block] = []
    here = Element("", None, "")
    elements, endless = [here], set()
    parts: list[str] = []
    opened: dict[str, int] = {}
    linked, in_link, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, here, min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            tag = end
        if tag > at:
            parts.append(page[at:tag])
            if in_link:
                linked += tag - at
        if tag == end:
            break
        following = page[tag + 1:tag + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", tag):
                close = page.find("-->", tag + 4)
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", tag)
                at = end if close < 0 else close + 1
            continue
        closing = following == "/"
        name = NAME.match(page, tag + 1 + closing)
        if not name:
            parts.append("<")
            at = tag + 1
            continue
        stop = TAG_END.match(page, name.end())
        close = stop.end() if stop else page.find(">", name.end()) + 1
        if close <= 0:
            break  # a tag cut off by the end of the page
        attributes = page[name.end():close - 1]
        at = close
        kind = name[0].lower()
        if kind == "br":
            parts.append(" ")
        elif kind == "a":
            in_link = 0 if closing else 1
        elif kind in UNREAD:
            if not closing and not attributes.endswith("/"):
                shut = None if kind in endless else CLOSERS[kind].search(page, at)
                if shut is not None:
                    close = page.find(">", shut.end())
                    at = end if close < 0 else close + 1
                else:
                    endless.add(kind)  # nor is there one further on
                    if kind in RAW:
                        at = end
                    elif kind == "option":
                        close = page.find("<", at)
                        at = end if close < 0 else close
        elif kind in BREAKING:
            flush()
            in_link = 0
            if closing:
                while opened.get(kind, 0):  # a stray end closes nothing
                    shut_tag, here = here.tag, here.parent
                    opened[shut_tag] -= 1
                    if shut_tag == kind:
                        break
            elif kind not in VOID:
                if here.tag == "p" or here.tag == kind and kind in ("li", "dt", "dd", "tr", "td", "th") or here.tag in HEADINGS:
                    opened[here.tag] -= 1
                    here = here.parent
                here = Element(kind, here, attributes)
                elements.append(here)
                opened[kind] = opened.get(kind, 0) + 1
    flush()
    settle(elements, blocks)
    return blocks


def leaning(block: Block, has_article: bool) -> float:
    """The classifier: above zero looks like article text."""
    element = block.element
    if element.outside:
        return OUTSIDE
    score = BASE + PER_LOG_WORD * log1p(block.words) + element.lean + LINKS * block.linked / len(block.text)
    if element.tag == "p":
        score += PARAGRAPH
    elif element.tag in HEADINGS:
        score += HEADING
    if element.article:
        score += IN_ARTICLE
    elif has_article:
        score += BESIDE_ARTICLE
    return score


def tree_distance(a: Element, b: Element) -> int:
    """Steps up and down between two elements, up to ``FAR_APART``."""
    steps = 0
    while a is not b and steps < FAR_APART:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    has_article = any(b.element.article and not b.element.outside for b in blocks)
    lean = [leaning(b, has_article) for b in blocks]
    edges, latest = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOURS / (1 + tree_distance(blocks[i - 1].element, block.element))))
        home = id(block.element.parent)
        before = latest.get(home)
        if before is not None:
            edges.append((before, i, SIBLINGS))
        latest[home] = i
    kept = source_side(lean, edges)
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of ``df`` with ``text`` and ``n_chars`` of every page."""
    prepared(df.sparkSession)

    def make():
        def compute(part, column):
            texts = [main_text(page) if page else "" for page in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return compute

    clear = df.select(*(c for c in df.columns if c == html or c not in ("text", "n_chars")))
    return map_texts(clear, html, [field("text", STRING), field("n_chars", LONG)], make)
