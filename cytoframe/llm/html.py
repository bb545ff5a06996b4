"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks, each with its word count and link density, those of its neighbours before
and after, and marks of where it stands (inside an article, inside a navigation-like or named boilerplate container, in a
heading, in a list). A decision tree trained on a small labelled table of blocks keeps or drops each block. Most pages of that table
name nothing: their menus, adverts, notices, comments and footers stand in the same containers as their articles, so the tree goes
by words and links first; a name, where a page has one, is one more feature. Blocks kept are
joined in page order by one space; character references are decoded and white space inside a block is one space.

Pages are independent: each task works through its own rows in bounded slices and nothing is shuffled.

Defined results: a null or empty page has an empty text; a page without markup is one block; unclosed tags end
with what holds them, an unclosed comment or script takes the rest of the page, as in browsers; repeated rows
give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.llm.common import parts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|iframe|template|svg|select|button|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?)\s*/?>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words of class, id and role names that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent contentinfo cookie cookies copyright "
    "disqus footer form gdpr header login menu menubar modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar topbar widget widgets".split()
)
CONTAINERS = frozenset("nav aside footer form menu dialog figcaption fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LISTED = frozenset("li td th dt dd option".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boilerplate", "article", "heading", "list", "sentence")


@dataclass
class Block:
    text: str
    words: int
    links: float
    boilerplate: bool
    article: bool
    heading: bool
    listed: bool
    label: bool | None = None


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(is boilerplate, is article) of an element."""
    if tag in CONTAINERS or tag == "header" and not in_article:
        return True, False
    if attrs:
        for m in NAMED.finditer(attrs):
            names = re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())
            if not BOILERPLATE.isdisjoint(names) and not (tag in ARTICLE or tag == "body"):
                return True, False
    return False, tag in ARTICLE


class Open:
    """The open elements: each knows how many boilerplate, article and list elements it stands in, itself included."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = []
        self.count: dict[str, int] = {}

    def marks(self) -> tuple[bool, bool, bool]:
        return tuple(n > 0 for n in self.stack[-1][1:]) if self.stack else (False, False, False)

    def push(self, tag: str, boilerplate: bool, article: bool) -> None:
        _, b, a, n = self.stack[-1] if self.stack else ("", 0, 0, 0)
        self.stack.append((tag, b + boilerplate, a + article, n + (tag in LISTED)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> bool:
        """Whether such an element was open; with it closes what it holds."""
        if not self.count.get(tag):
            return False
        while True:
            gone = self.stack.pop()[0]
            self.count[gone] -= 1
            if gone == tag:
                return True

    def close_like(self, tag: str) -> None:
        """An element that ends the one of its kind before it, if only paragraphs stand between."""
        k = len(self.stack) - 1
        while k >= 0 and self.stack[k][0] == "p" != tag:
            k -= 1
        if k >= 0 and self.stack[k][0] == tag:
            self.close(tag)

    def clear(self) -> None:
        self.stack.clear()
        self.count.clear()


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; linear in the page, however deep its elements stand."""
    out: list[Block] = []
    stack = Open()
    text: list[str] = []
    linked: list[str] = []
    state = {"link": False, "heading": False, "label": None}

    def flush() -> None:
        shown = " ".join(html.unescape("".join(text)).split()) if text else ""
        if shown:
            words = shown.count(" ") + 1
            in_links = len(html.unescape(" ".join(linked)).split())
            boilerplate, article, listed = stack.marks()
            out.append(Block(shown, words, min(1.0, in_links / words), boilerplate, article, state["heading"], listed, state["label"]))
        text.clear()
        linked.clear()

    def take(part: str) -> None:
        if part:
            text.append(part)
            if state["link"]:
                linked.append(part)

    at = 0
    for m in TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                take(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            state["link"] = not m["end"]
        if tag in INLINE:
            continue
        if tag == "br":
            take(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            state["heading"] = state["heading"] and tag not in HEADINGS
            if stack.close(tag):
                state["link"] = False
            continue
        if tag in HEADINGS:
            state["heading"] = True
        elif tag == "body":
            stack.clear()
        attrs = m["attrs"]
        if tag == "p" and not attrs:
            continue
        if tag in ("p", "li"):  # opens by closing its like
            stack.close_like(tag)
        if "data-main" in attrs:
            state["label"] = 'data-main="1"' in attrs
        stack.push(tag, *_marks(tag, attrs, stack.marks()[1]))
    take(page[at:])
    flush()
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.links for b in blocks], float)
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    marks = np.array([(b.boilerplate, b.article, b.heading, b.listed, b.text[-1] in ".!?…\"'”»)") for b in blocks], float)
    return np.column_stack([words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1), marks])


@dataclass(frozen=True)
class Node:
    """A split (feature <= threshold goes left), or a leaf with its share of main blocks."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Node:
    """CART with Gini impurity; ties go to the first feature."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Node(share)
    gini = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = (gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if least <= low.sum() <= len(y) - least and (g := gini(y[low]) + gini(y[~low])) < best[0] - 1e-9:
                best = (g, f, float(cut))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.left is None:
            out[rows] = node.share
        else:
            low = x[rows, node.feature] <= node.threshold
            todo += [(node.left, rows[low]), (node.right, rows[~low])]
    return out


@lru_cache(1)
def default_tree() -> Node:
    """The tree of the labelled table in ``html_training``."""
    from cytoframe.llm.html_training import PAGES

    xs, ys = [], []
    for page in PAGES:
        blocks = page_blocks(page)
        xs.append(block_features(blocks))
        ys += [bool(b.label) for b in blocks]
    return fit_tree(np.vstack(xs), np.array(ys, float))


def main_text(page: str, tree: Node) -> str:
    blocks = page_blocks(page)
    if not blocks:
        return ""
    keep = predict(tree, block_features(blocks)) >= 0.5
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text (main text), a row for each page."""
    tree = tree or default_tree()
    source = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages_ in parts(batches, "html"):
            found = pa.array([main_text(p, tree) for p in pages_], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], names=["page_id", "url", "text"])

    return source.mapInArrow(run, schema)
