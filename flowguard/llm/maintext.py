"""Main text of web pages: flat blocks, judged by a decision tree over their own and their neighbours' shape.

A page is cut into blocks of text at every tag that isn't inline. A block's features are its number of words and its link density
(the share of its words inside links), the same of the blocks before and after it (Kohlschuetter, Fankhauser and Nejdl 2010),
whether it is a heading, and what the nearest enclosing element that says so is for: the article (article, main, and classes such
as `content`) or something beside it (nav, aside, footer, form, and classes such as `sidebar`, `cookie`, `comments`; without any, a line of copyright is something beside it). A tree grown
on a small labelled table of blocks decides which blocks stay. The table is drawn by rule (`lessons`), half of it without any hint
by element or class, so that pages in bare paragraphs are read by word counts and link densities alone.

Text inside a block has its character references decoded and each stretch of white space turned into one space; kept blocks stand
in page order with one line feed between them. Whole pages are read, in time in proportion to their length; scripts, styles, form
controls and comments of the markup never make blocks. A start tag, comment or script that doesn't end runs to the end of the page.

Null, empty and markup-only pages have an empty text and 0 characters. Repeated rows are judged alike. Columns of other names are
carried along; `text` and `n_chars` of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import slices

#: Fixed values of HTML: elements that stand within a line of text, and those whose content isn't text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style title noscript template iframe object svg math canvas audio video select textarea button datalist noembed noframes xmp".split())
TO_THE_END = frozenset("script style title textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends; others end a paragraph.
ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr")}
#: What an element or a word of its class, id or role says about the text in it.
ASIDE_TAGS = frozenset("nav aside footer form fieldset menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer "
    "disqus discussion footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar toc widget".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody body content entry main maintext post story text".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WHOLE, _PARTS = re.compile(r"[A-Za-z]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in UNSEEN}
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I)
_WIDE = re.compile("[⺀-꓏가-힯豈-﫿\U00020000-\U0003ffff]")

#: Order of a block's features; the first six stand for the block before, the block and the block after.
FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "side", "heading", "header")


def _side(tag: str, attributes: str) -> int:
    """1 if an element is for the article, -1 if for something beside it, -2 if it is a header, else 0."""
    if tag in ("html", "body"):
        return 0
    if tag in ASIDE_TAGS or (attributes and _HIDDEN.search(attributes)):
        return -1
    names = " ".join([m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)]) if attributes else ""
    words = {w.lower() for w in _WHOLE.findall(names) + _PARTS.findall(names)}
    if tag not in MAIN_TAGS and not ASIDE_WORDS.isdisjoint(words):
        return -1
    if tag == "header" or "header" in words:
        return -2
    return 1 if tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(words) else 0


def count_words(text: str) -> int:
    """Words between blanks; of scripts without blanks two characters count as a word."""
    return len(text.split()) + len(_WIDE.findall(text)) // 2


def blocks(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, side, heading, header) of each block with text, in page order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    parts: list[tuple[str, bool]] = []
    open_: list[tuple[str, int]] = []
    at, in_link, heading = 0, 0, 0

    def flush() -> None:
        text = " ".join(unescape("".join(x for x, _ in parts)).split())
        if text:
            side = next((s for _, s in reversed(open_) if abs(s) == 1), -int(bool(_RIGHTS.match(text))))
            links = sum(count_words(unescape(x)) for x, linked in parts if linked)
            out.append((text, words := count_words(text), min(links, words), side, int(heading > 0), int(any(s == -2 for _, s in open_))))
        parts.clear()

    while at < len(html):
        mark = _TAG.search(html, at)
        if mark is None:
            parts.append((html[at:], in_link > 0))
            break
        if mark.start() > at:
            parts.append((html[at : mark.start()], in_link > 0))
        at = mark.end()
        tag = (mark[2] or mark[5] or "").lower()
        if not tag:
            continue
        closes, attributes = bool(mark[1] or mark[4]), mark[3] if mark[2] else mark[6]
        if tag in UNSEEN and not closes:
            end = _END[tag].search(html, at)
            at = end.end() if end else len(html) if tag in TO_THE_END else at
            parts.append((" ", False))
        elif tag == "a":
            in_link = 0 if closes else 1
        elif tag == "br":
            parts.append((" ", False))
        elif tag not in INLINE:
            flush()
            in_link = 0
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = 0 if closes else 1
            elif heading and tag in ("p", "div", "article", "section"):
                heading = 0
            if closes:
                if any(t == tag for t, _ in open_):
                    while open_.pop()[0] != tag:
                        pass
                continue
            while open_ and open_[-1][0] in ENDED_BY.get(tag, ("p",)):
                open_.pop()
            if tag not in VOID:
                open_.append((tag, _side(tag, attributes)))
    flush()
    return out


def features(page: np.ndarray, words: np.ndarray, links: np.ndarray, side: np.ndarray, heading: np.ndarray, header: np.ndarray) -> np.ndarray:
    """FEATURES of blocks in order; blocks of the same page stand together. What lies beyond a page's ends has no words and no links."""
    density = links / np.maximum(words, 1)
    same = np.r_[False, page[1:] == page[:-1], False] if len(page) else np.zeros(1, bool)
    before = lambda x: np.where(same[:-1], np.r_[0, x[:-1]], 0)
    after = lambda x: np.where(same[1:], np.r_[x[1:], 0], 0)
    return np.column_stack([before(words), words, after(words), before(density), density, after(density), side, heading, header]).astype(float) if len(page) else np.zeros((0, 9))


def lessons(pages: int = 240, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: (features, 1 for blocks of an article) of made-up pages, by rule. Every second page has no hints at all."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[int, ...]] = []

    def n(low: int, high: int) -> int:
        return int(rng.integers(low, high + 1))

    def often(share: float) -> bool:
        return bool(rng.random() < share)

    for page in range(pages):
        # which hints a page gives: half of them none, some mark the article alone, some only what lies beside it
        beside, inside = -int(page % 2 and page % 8 != 1), int(page % 2 and page % 8 != 3)
        plain = page % 10 in (4, 5)  # nothing but text

        def add(label: int, words: int, links: int = 0, side: int = 0, heading: int = 0, header: int = 0, page: int = page) -> None:
            rows.append((page, words, min(links, words), side, heading, header, label))

        if not plain:
            if beside and often(0.3):
                add(0, n(8, 40), n(0, 2), beside)  # notice
            if often(0.5):
                add(0, n(1, 14) if beside else n(1, 5), 5 * n(0, 1) if beside else 5, 0, 1, -beside)  # the site's name
            for _ in range(n(3, 8) if often(0.9) else 0):
                add(0, w := n(1, 3), w, beside)  # menu
            if often(0.6):
                add(0, n(4, 14), n(0, 1) * n(0, 6), beside)  # advert
            if often(0.2):
                add(0, n(15, 40) if beside else n(4, 9), 4, beside)  # notice
        if often(0.8) and not plain:
            header = int(inside and often(0.5))
            add(1, n(3, 14), 0, inside, 1, header)
            if header:
                add(0, n(2, 9), n(0, 2), inside, 0, 1)  # author and date
        for i in range(k := n(1, 3) if plain else n(2, 9)):
            words = n(4, 120) if plain else n(25, 160) if i in (0, k - 2) else n(1, 6) if often(0.25) else n(8, 120)
            add(1, words, 0 if often(0.7) else int(words * rng.random() * 0.25), inside)
            if often(0.12) and i < k - 1:
                add(1, n(1, 8), 0, inside, 1)
            if beside and not plain and often(0.1):
                add(0, n(3, 60), n(0, 8), beside)
        if inside and often(0.6):
            add(1, n(1, 6), 0, inside)
        if plain:
            continue
        if beside and often(0.6):
            for _ in range(n(1, 4)):
                add(0, n(2, 90), 0, beside)  # reader comments
                add(0, 1, 1, beside)
        if often(0.5):
            for _ in range(n(2, 6)):
                add(0, w := n(3, 10), w, beside)  # what else to read
        if often(0.4):
            add(0, n(3, 12), n(1, 3), beside)  # form
        if beside:
            add(0, n(3, 16), n(0, 8), beside)
        else:
            add(0, w := n(3, 12), w)
    table = np.array(rows)
    return features(*table[:, :6].T), table[:, 6]


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> np.ndarray:
    """A decision tree by Gini impurity as rows (feature, limit, child at or below it, child above, value); feature -1 is a leaf."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, y[rows].mean()])
        best = (rows.size * y[rows].mean() * (1 - y[rows].mean()) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if left and rows.size >= 2 * least else ():
            by = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[by, f], np.cumsum(y[by])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (rows.size - cut - 1 >= least)]
            if not cut.size:
                continue
            a, b = cut + 1, rows.size - cut - 1
            p, q = ones[cut] / a, (ones[-1] - ones[cut]) / b
            loss = a * p * (1 - p) + b * q * (1 - q)
            i = int(np.argmin(loss))
            if loss[i] < best[0]:
                best = (loss[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
        if best[1] >= 0:
            under = x[rows, best[1]] <= best[2]
            nodes[me][:4] = best[1], best[2], grow(rows[under], left - 1), grow(rows[~under], left - 1)
        return me

    grow(np.arange(len(y)), depth)
    return np.array(nodes)


def tree_values(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of article blocks in the leaf of each row."""
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while (inner := tree[at, 0] >= 0).any():
        under = x[rows, np.maximum(tree[at, 0], 0).astype(int)] <= tree[at, 1]
        at = np.where(inner, np.where(under, tree[at, 2], tree[at, 3]).astype(int), at)
    return tree[at, 4]


def main_texts(pages: list[str], tree: np.ndarray) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    flat = np.array([b[1:] for page in cut for b in page], np.int64).reshape(-1, 5)
    number = np.repeat(np.arange(len(cut)), [len(page) for page in cut])
    stays = iter(tree_values(tree, features(number, *flat.T)) > 0.5)
    return ["\n".join([b[0] for b in page if next(stays)]) for page in cut]


def extract(pages: DataFrame, tree: np.ndarray | None = None) -> DataFrame:
    """pages without html, with text (main text, empty if none) and n_chars (its code points)."""
    tree = grow_tree(*lessons()) if tree is None else tree
    others = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts([x or "" for x in part.column("html").to_pylist()], tree)
                columns = [part.column(f.name) for f in others] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pages.select(*[f"`{f.name}`" for f in others], "html").mapInArrow(run, schema)
