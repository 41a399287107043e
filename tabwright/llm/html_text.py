"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; the page becomes lines, one per block element, each with its text and the
tags around it. The ratio of text to tags per line is smoothed with a Gaussian, lines above a threshold are clustered as
content, and the core of the page is the innermost container that holds nearly all of them, or the article or main
element around it. All lines of the core are kept, short ones too; of the others those that belong to an article by
their links, ratio or heading (`belongs`). Elements that are named like page furniture are left out only where the
share of the page's text they hold agrees (`left_out`).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED_CHARS = 1 << 16
SIGMA = 1.0
#: Lines whose smoothed ratio is above this share of the page's standard deviation are content.
THRESHOLD = 0.5
#: The region holds this share of the content's text.
REGION = 0.9
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without article text.
NEVER = frozenset(
    "audio button canvas datalist head iframe input label map noscript object option script select style svg template textarea title video".split()
)
#: Elements beside an article; a header only outside of one, where it isn't its heading.
BESIDE = frozenset("aside footer header menu nav search".split())
#: Elements and words in a class, id or role that often mark what is no article text.
MARKED_TAGS = frozenset("dialog fieldset form".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer form gdpr menu "
    "menubar modal nav navbar navigation newsletter notice notices notification overlay pagination popup popups promo promoted promotion related replies "
    "reply search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe teaser toolbar tooltip widget".split()
)
#: Marked elements are kept where one, or all with the same word, hold this share of the text; the second one counts
#: beside an article or main element with text of its own. Together those left out hold at most ``LEFT_OUT`` without such an element.
MAJOR = (0.5, 0.9)
LEFT_OUT = 0.75
#: A line with this share of its text in links is a list of links.
LINKED = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
NO_MARKS: frozenset[str] = frozenset()
#: What an opening tag closes when it is open: paragraphs by any block, items by the next item.
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
BARS = BLOCKS.difference(PARAGRAPHS)
LISTS = frozenset(("ul", "ol", "dl", "table", "select", "menu"))
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPACE = re.compile(r"\s+")
UNENDED = re.compile(r"</?[A-Za-z]")
PARTS = re.compile(r"[a-z]+")


def marks(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    """The words by which an element may be no article text."""
    if tag in ("html", "body", "article", "main"):
        return NO_MARKS
    found = {tag} if tag in MARKED_TAGS else set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            found |= MARKS.intersection(PARTS.findall(value.lower()))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.add("hidden")
    return frozenset(found) if found else NO_MARKS


class Lines(HTMLParser):
    """Gathers lines ``(parts, tags)`` per block, with parts ``(text, node, in a link)``.

    Nodes are the block elements and the marked ones; a node's parent comes before it. Node 0 is the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, bool]], int]] = []
        self.tag, self.parent, self.marks, self.beside = [""], [0], [NO_MARKS], [False]
        self.stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
        #: Places in the stack by tag, and of the elements past which paragraphs and items are not closed.
        self.places: dict[str, list[int]] = {}
        self.bars: list[int] = []
        self.lists: list[int] = []
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = 1

    def end_line(self) -> None:
        if any(text and not text.isspace() for text, *_ in self.parts):
            self.lines.append((self.parts, self.tags))
            self.tags = 1
        self.parts = []

    def add(self, text: str) -> None:
        _, skipped, _, linked, node = self.stack[-1]
        if not skipped:
            self.parts.append((text, node, linked))

    def push(self, element: tuple[str, bool, bool, bool, int]) -> None:
        tag = element[0]
        for places in self.held(tag):
            places.append(len(self.stack))
        self.stack.append(element)

    def held(self, tag: str) -> list[list[int]]:
        found = [self.places.setdefault(tag, [])]
        if tag in BARS:
            found.append(self.bars)
        if tag in LISTS:
            found.append(self.lists)
        return found

    def close_to(self, at: int) -> None:
        block = False
        for tag, *_ in self.stack[at:]:
            block = block or tag in BLOCKS
            for places in self.held(tag):
                places.pop()
        if block:
            self.end_line()
        del self.stack[at:]

    def opened(self, names: tuple[str, ...], bars: list[int]) -> int | None:
        """The place of the innermost open element of these names, if it is not outside of one in ``bars``."""
        at = max((self.places[name][-1] for name in names if self.places.get(name)), default=0)
        return at if at and not (bars and bars[-1] > at) else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in BLOCKS:
                self.end_line()
            elif tag in ("br", "img", "input", "wbr"):
                self.add("" if tag == "wbr" else " ")
            return
        if tag in BLOCKS:
            self.end_line()
            if (at := self.opened(PARAGRAPHS, self.bars)) is not None and tag != "hgroup":
                self.close_to(at)
            if tag in ITEMS and (at := self.opened(ITEMS[tag], self.lists)) is not None:
                self.close_to(at)
        _, skipped, article, linked, node = self.stack[-1]
        found = marks(tag, attrs) if attrs or tag in MARKED_TAGS else NO_MARKS
        if tag in BLOCKS or found:
            self.tag.append(tag)
            self.parent.append(node)
            self.marks.append(found)
            self.beside.append(tag in BESIDE and not (tag == "header" and article))
            node = len(self.tag) - 1
        self.push((tag, skipped or tag in NEVER, article or tag in ARTICLES, linked or tag == "a", node))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in ("p", "br"):  # </br> and a stray </p> part lines as browsers have it
            self.end_line() if tag == "p" else self.add(" ")
        if (at := self.opened((tag,), [])) is not None:
            self.close_to(at)

    def handle_data(self, data: str) -> None:
        self.add(data)

    def up(self, values: list, joined) -> list:
        """Values per node joined with those of all nodes in it."""
        for node in range(len(values) - 1, 0, -1):
            values[self.parent[node]] = joined(values[self.parent[node]], values[node])
        return values

    def down(self, values: list, joined) -> list:
        """Values per node joined with those of all nodes around it."""
        for node in range(1, len(values)):
            values[node] = joined(values[self.parent[node]], values[node])
        return values


def left_out(page: Lines) -> list[bool]:
    """Per node whether its text is left out.

    An element that holds an article or main element is never left out for what it is called. Other marked elements
    are kept if one of them, or all those with the same word, hold the major part of the text of the article or main
    element around them, or else of the page. Without an article element with text beside them, the words that hold
    most count no more until a part of that text is left.
    """
    article = page.up([tag in ARTICLES for tag in page.tag], lambda a, b: a or b)
    out = page.down([beside and not holds for beside, holds in zip(page.beside, article, strict=True)], lambda a, b: a or b)
    if not any(page.marks):
        return out
    own = [0] * len(out)
    for parts, _ in page.lines:
        for text, node, _ in parts:
            if not out[node]:
                own[node] += len(text.strip())
    held = page.up(list(own), int.__add__)
    scope = page.down([node if tag in ARTICLES else 0 for node, tag in enumerate(page.tag)], lambda a, b: b or a)
    named = [m if not a else NO_MARKS for m, a in zip(page.marks, article, strict=True)]
    in_named = page.down([bool(m) for m in named], lambda a, b: a or b)
    clear = [False] * len(out)
    for at in {s for n, s, m in zip(own, scope, in_named, strict=True) if n and s and not m}:
        while at and not clear[scope[page.parent[at]]]:
            at = scope[page.parent[at]]
            clear[at] = True
    major = [MAJOR[clear[s]] * held[s] for s in scope]
    words = page.down([m if h < most else NO_MARKS for m, h, most in zip(named, held, major, strict=True)], lambda a, b: a | b if b else a)
    chars: dict[int, dict[frozenset[str], int]] = {}
    for at, found, n in zip(scope, words, own, strict=True):
        if found and n:
            of = chars.setdefault(at, {})
            of[found] = of.get(found, 0) + n
    telling = {}
    for at, of in chars.items():
        by_word: dict[str, int] = {}
        for found, n in of.items():
            for word in found:
                by_word[word] = by_word.get(word, 0) + n
        left = {word for word, n in by_word.items() if n < major[at]}
        while not clear[at] and sum(n for found, n in of.items() if not left.isdisjoint(found)) > LEFT_OUT * held[at]:
            left.remove(max(left, key=lambda word: (by_word[word], word)))
        telling[at] = left
    return [o or not telling.get(at, NO_MARKS).isdisjoint(found) for o, at, found in zip(out, scope, words, strict=True)]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def core_of(page: Lines, nodes: list[int], sizes: list[int], content: np.ndarray) -> int:
    """The innermost node, other than a block without blocks in it, with ``REGION`` of the content; or the outermost
    article or main element around it."""
    held, any_line = [0] * len(page.tag), [False] * len(page.tag)
    for node, size, is_content in zip(nodes, sizes, content, strict=True):
        held[node] += size if is_content else 0
        any_line[node] = True
    held, any_line = page.up(held, int.__add__), page.up(any_line, lambda a, b: a or b)
    container = [tag in ARTICLES for tag in page.tag]
    for node in range(1, len(container)):
        container[page.parent[node]] |= any_line[node]
    core = 0
    for node in range(1, len(container)):  # the nodes that hold REGION lie within each other
        if container[node] and held[node] >= REGION * held[0]:
            core = node
    node = around = core
    while node:
        around = node if page.tag[node] in ARTICLES else around
        node = page.parent[node]
    return around


def main_text(html: str | None) -> str:
    """Lines of the page's core and those beside it that belong to it, joined by blank lines; empty if there is no text."""
    page = Lines()
    for at in range(0, len(html or ""), FEED_CHARS):
        page.feed(html[at : at + FEED_CHARS])
    if page.rawdata.startswith("<!--") or (UNENDED.match(page.rawdata) and ">" not in page.rawdata):
        page.rawdata = ""  # a comment or tag that the page ends in; the parser would look for its end at each "<" again
    page.close()
    page.end_line()
    out = left_out(page)
    lines, tags_of, nodes, linked = [], [], [], []
    for parts, tags in page.lines:
        kept = [part for part in parts if not out[part[1]]]
        if text := SPACE.sub(" ", "".join(part[0] for part in kept)).strip():
            node = kept[0][1]
            while node and page.tag[node] not in BLOCKS:
                node = page.parent[node]
            lines.append(text)
            tags_of.append(tags)
            nodes.append(node)
            linked.append(sum(len(part[0]) for part in kept if part[2]) >= LINKED * len(text))
    if not lines:
        return ""
    ratios = np.array([len(text) / tags for text, tags in zip(lines, tags_of, strict=True)])
    smooth = smoothed(ratios)
    threshold = min(THRESHOLD * smooth.std(), smooth.max() * 0.999)
    core = core_of(page, nodes, [len(text) for text in lines], smooth > threshold)
    in_core = page.down([node == core for node in range(len(page.tag))], lambda a, b: a or b)
    in_article = page.down([tag in ARTICLES for tag in page.tag], lambda a, b: a or b)
    clear = page.tag[core] in ARTICLES

    def belongs(i: int) -> bool:
        """Whether a line beside the core is kept: text, not links; beside an article element only other articles,
        headings and lines with the ratio of content."""
        if linked[i]:
            return False
        return not clear or in_article[nodes[i]] or page.tag[nodes[i]] in HEADINGS or max(ratios[i], smooth[i]) > threshold

    return "\n\n".join(text for i, text in enumerate(lines) if in_core[nodes[i]] or belongs(i))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``. A null or empty page has an empty text; rows stay apart.

    An empty table gives no rows. A page takes time in proportion to its length, also one with elements that are never
    closed or never opened, and memory for its own text and elements.
    """

    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(html) for html in pages], dtype=object)

    found = pages.select("page_id", "url", F.pandas_udf(extract, "string")(F.col("html").cast("string")).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
