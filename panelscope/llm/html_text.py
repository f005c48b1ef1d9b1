"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks.  A block's features are its
words, its link density, the same of the block before and after, and what the
innermost marked container says (article or main, or one of menus, notices,
adverts, forms and the like, by tag, role, class or id).  A tree grown from the
small labelled table below decides which blocks are text.

Cases: null and empty pages, and pages without text, give an empty text;
truncated tags, comments and character references at the end of a page are
markup or plain text, never an error; repeated pages get a row each; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelscope.llm.common import slices

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Elements whose content is no text, up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "audio", "video", "canvas", "select", "datalist"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Containers that are kept on the stack; paragraphs and inline tags are not.
CONTAINER = set("article aside body button center details dialog div dl fieldset figure footer form head header hgroup label main menu nav ol search section table td ul span".split())

MAIN, NEUTRAL, OTHER = 1, 0, -1
TAGS = {"article": MAIN, "main": MAIN, "nav": OTHER, "footer": OTHER, "aside": OTHER, "form": OTHER, "button": OTHER, "dialog": OTHER, "menu": OTHER, "head": OTHER, "label": OTHER, "fieldset": OTHER, "search": OTHER}
ROLES = {"main": MAIN, "article": MAIN, "navigation": OTHER, "banner": OTHER, "contentinfo": OTHER, "complementary": OTHER, "search": OTHER, "form": OTHER, "dialog": OTHER, "alertdialog": OTHER, "alert": OTHER, "menu": OTHER, "menubar": OTHER, "toolbar": OTHER}
#: Words of class and id that mark what is no article.
OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus reply replies respond share sharing "
    "social related recommended subscribe subscription newsletter signup login register search widget tags pagination pager copyright disclaimer skip".split()
)
MAIN_WORDS = set("article content story post entry main".split())


def mark(tag: str, attributes: str, inside: int) -> int | None:
    """What a container says about its text; None: nothing."""
    found = TAGS.get(tag, OTHER if tag == "header" and inside != MAIN else None)
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            value, name = html.unescape(value.strip("\"'")).lower(), name.lower()
            if name == "role" and value in ROLES:
                found = ROLES[value]
            elif name in ("class", "id"):
                names = re.findall(r"[a-z0-9]+", value)
                if OTHER_WORDS.intersection(names):
                    return OTHER
                if found is None and MAIN_WORDS.intersection(names):
                    found = MAIN
            elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return OTHER
        if found != OTHER and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I):
            return OTHER
    return found


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, container mark, heading level or 0) in page order."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    link, heading, at, inside = False, 0, 0, NEUTRAL

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if link:
                linked.append(piece)

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), inside, heading))
            parts.clear()
            linked.clear()

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if tag in BLOCK:
                flush()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            text(" ")
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            link = not closing
            continue
        if tag in BLOCK:
            flush()
            link = False
            heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not closing else 0
        if tag in CONTAINER:
            if not closing:
                says = mark(tag, m[3], inside)
                if says is not None and tag == "span":
                    flush()
                stack.append((tag, inside))
                inside = inside if says is None else says
            elif any(t == tag for t, _ in stack):
                if tag == "span" and stack[-1][1] != inside:
                    flush()
                while True:
                    top, inside_before = stack.pop()
                    inside = inside_before
                    if top == tag:
                        break
    flush()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark", "heading")


def features(found: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], links[:-1], words[1:], links[1:]
    x[:, 6], x[:, 7] = [b[3] for b in found], [float(b[4] > 0) for b in found]
    return x


#: Labelled by hand: the features above and 1 for text.
LABELLED = """
1 1 0 0 1 1 -1 0 0
1 1 1 1 1 1 -1 0 0
2 1 1 1 8 0 -1 0 0
6 0 1 1 10 0 -1 0 0
8 0 1 1 12 0 -1 0 0
14 0 120 0 0 0 -1 0 0
9 0 60 0 0 0 -1 0 0
25 .1 80 0 4 0 -1 0 0
40 0 90 0 30 0 -1 0 0
70 0 30 0 20 0 -1 0 0
120 0 60 0 5 0 -1 0 0
3 0 40 0 60 0 -1 1 0
5 .2 3 1 4 1 -1 0 0
30 .9 12 1 12 1 -1 0 0
10 0 6 0 50 0 1 1 1
6 0 8 0 300 0 1 1 1
4 0 10 0 12 0 1 1 1
1 0 6 0 30 0 1 0 1
2 0 200 0 90 0 1 0 1
3 0 1 0 1 0 1 0 1
7 0 60 0 14 0 1 0 1
12 0 10 0 40 0 1 0 1
45 0 12 0 7 0 1 0 1
180 .02 9 0 45 0 1 0 1
400 0 10 0 12 .1 1 0 1
20 .3 90 0 60 0 1 0 1
14 .5 60 0 70 0 1 0 1
9 .4 30 0 45 0 1 0 1
3 1 50 0 60 0 1 0 1
1 1 1 1 1 1 1 0 0
2 1 2 1 2 1 1 0 0
5 1 4 1 6 1 1 0 0
8 .95 9 1 5 1 1 0 0
60 0 50 0 70 0 0 0 1
35 .05 40 0 55 .1 0 0 1
24 0 60 0 45 0 0 0 1
90 .1 5 1 60 0 0 0 1
150 0 4 0 4 1 0 0 1
18 0 70 0 80 0 0 0 1
12 0 90 .05 65 0 0 0 1
9 0 55 0 90 0 0 0 1
5 0 45 0 50 0 0 0 1
7 0 3 1 80 0 0 1 1
4 0 60 0 75 0 0 1 1
50 0 60 0 1 1 0 0 1
80 0 90 0 2 1 0 0 1
40 .05 70 0 5 0 0 0 1
30 0 40 0 1 1 0 0 1
65 .1 80 0 3 1 0 0 1
55 0 1 1 70 0 0 0 1
2 0 1 1 2 1 0 0 0
4 0 2 1 3 0 0 0 0
6 0 5 0 4 1 0 0 0
3 0 0 0 4 1 0 0 0
8 .2 3 1 5 .5 0 0 0
10 .8 4 1 8 .9 0 0 0
25 .7 10 .8 12 .9 0 0 0
45 .8 20 .9 15 .7 0 0 0
1 1 1 1 1 1 0 0 0
2 1 3 1 60 0 0 0 0
3 1 70 0 2 1 0 0 0
6 0 4 0 3 0 0 0 0
7 0 80 0 0 0 0 0 0
5 0 60 0 3 1 0 0 0
3 0 2 0 4 0 0 1 0
"""


class Tree:
    """Binary decision tree by Gini impurity; leaves hold the share of text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.share, self.split = float(y.mean()) if len(y) else 0.0, None
        if depth and 0 < self.share < 1:
            best = None
            for k in range(x.shape[1]):
                values = np.unique(x[:, k])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, k] <= cut
                    a, b = y[low], y[~low]
                    impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, k, cut
            if best:
                _, k, cut = best
                low = x[:, k] <= cut
                self.split = k, cut, Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def shares(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.share)
        k, cut, low, high = self.split
        out = np.empty(len(x))
        left = x[:, k] <= cut
        out[left], out[~left] = low.shares(x[left]), high.shares(x[~left])
        return out


@cache
def classifier() -> Tree:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return Tree(rows[:, :-1], rows[:, -1])


def main_texts(pages: list[str]) -> list[str]:
    """Text of each page; the pages' blocks are classified together."""
    found = [blocks(p) for p in pages]
    x = [features(f) for f in found if f]
    keep = iter(classifier().shares(np.concatenate(x)) >= 0.5) if x else iter(())
    return ["\n".join([b[0] for b in f if next(keep)]) for f in found]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page, no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = main_texts([h or "" for h in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
