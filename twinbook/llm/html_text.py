"""Main text of web pages from flat text blocks and a trained decision tree.

A page is read once, front to back, into flat blocks of text: block-level tags
end a block, inline tags do not. What stands in elements that are no article by
their role (menus, headers, footers, sidebars, notices, adverts, forms, comments)
is no block, as scripts and styles are none. Each block is described by its word
count and link density and by those of the blocks before and after it. A decision
tree, trained on the small labelled table below, keeps or drops it: it finds the
menus and link lists that no role tells of. Kept blocks, white space turned into
single spaces, are joined by two newlines.

Edge cases: null and empty html give an empty text; markup that is cut off at
the end of the page, or never closed, is read as far as it goes (a head without
its end tag hides no more than its title, scripts and styles); pages of any
length are read whole; repeated rows are read each on its own; an empty table
gives an empty result; columns named text or n_chars are replaced, all others
pass by untouched, whatever their names.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# Element names of HTML.
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea datalist title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose role is not the article, and words of class, id or role that say so.
ASIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
MAIN = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation "
    "newsletter notice popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words that name the whole element only as a name of their own: "sidebar" is one, "content-sidebar-wrap" and "entry-header" are not.
FRAME_WORDS = frozenset("header sidebar".split())
#: A name with one of these tells of the page, not of the element: "has-sidebar", "no-comments".
STATE_WORDS = frozenset("has no with without".split())
#: An <article> inside these is a comment or a teaser. In all other aside elements (also those never closed) it is the article.
TEASERS = frozenset("aside dialog".split())
TEASER_WORDS = frozenset("ad ads advert advertisement advertising comment comments disqus promo promoted related reply replies respond sponsor sponsored".split())
#: Elements that a form holds only if it is wrapped around the page.
PAGE_PARTS = frozenset("article aside footer h1 header main nav".split())
#: Page-frame elements that are part of the article inside it (its own headline).
ARTICLE_PARTS = frozenset({"header"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@lru_cache(1 << 14)
def _said(value: str) -> tuple[frozenset[str], frozenset[str], frozenset[str], bool]:
    """Of a class, id or role: words of ASIDE_WORDS, those that begin a name, words of MAIN_WORDS, and whether one of these is a whole name."""
    aside, begin, main, whole = set(), set(), set(), False
    for name in value.lower().split():
        words = _WORD.findall(name)
        if len(words) > 1 and not FRAME_WORDS.isdisjoint(words):
            words = [w for w in words if w in ASIDE_WORDS and w not in FRAME_WORDS]
        found = ASIDE_WORDS.intersection(words) if STATE_WORDS.isdisjoint(words) else ()
        aside.update(found)
        begin.update(w for w in words[:1] if w in found)
        main.update(MAIN_WORDS.intersection(words))
        whole = whole or name in MAIN_WORDS
    return frozenset(aside), frozenset(begin), frozenset(main), whole


def _kind(name: str, attributes: str, inside: int) -> int:
    """1: not the article, 3: not the article but for an <article> inside, 2: the article, 0: says nothing (then the parent's kind holds).

    Below 0 is a form, for which the rest of the page decides.
    """
    aside: set[str] = set()
    main, whole = False, False
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            said = _said(m[1] or m[2] or m[3] or "")
            aside |= said[1] - FRAME_WORDS if name == "article" else said[0]
            main, whole = main or bool(said[2]), whole or said[3]
    if name in ("html", "head", "body"):
        aside = set()
    if inside == 2 and name in ARTICLE_PARTS:
        aside -= ARTICLE_PARTS
    if name == "main":
        return 2
    if aside or (name in ASIDE and not (inside == 2 and name in ARTICLE_PARTS)):
        return 1 if inside == 1 or name in TEASERS or aside & TEASER_WORDS else 3
    if (name in MAIN and inside != 1) or (main and inside in (0, 2)) or (whole and inside < 0):
        return 2
    return 0


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    """Flat text of a page: (text, words, words in links, kind of the surroundings); kind 1 is no article by its role."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open block elements and kinds
    text: list[str] = []
    linked, in_link, hidden, at = 0, 0, None, 0
    forms, around = 0, set()  # forms outside the article, and those around the page

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((joined, joined.count(" ") + 1, linked, stack[-1][1] if stack else 0))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if hidden is None and raw:
            part = unescape(raw) if "&" in raw else raw
            text.append(part)
            if in_link:
                linked += len(part.split())

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if hidden is not None:
            hidden = None if closing and name == hidden else hidden
            continue
        if name in HIDDEN and not closing:
            if name not in VOID and not m[3].endswith("/"):
                hidden = name
                if name in RAW:  # markup inside is text
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                    at = end.start() if end else len(html)
            continue
        if name in INLINE:
            if name == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            elif name == "br":
                add(" ")
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    in_link = 0
                    break
        else:
            if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                stack.pop()  # these end one another
            inside = stack[-1][1] if stack else 0
            if inside in around:
                inside = 0
            kind = _kind(name, m[3] or "", inside)
            if inside < 0 and (kind == 2 or name in PAGE_PARTS):
                around.add(inside)
                inside = 0
            if name == "form" and kind == 3 and inside == 0:
                forms += 1
                kind = -forms
            stack.append((name, kind or inside))
    add(html[at:])
    flush()
    alone = all(b[3] not in (0, 2) for b in out)  # then a form holds what text the page has
    return [(*b[:3], b[3] if 0 <= b[3] < 3 else 0 if b[3] < 0 and (alone or b[3] in around) else 1) for b in out]


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """Per block (text, words, words in links): words and link density of it, of the block before and of that after (0, 0 at the ends)."""
    words = np.array([0, *(b[1] for b in found), 0], float)
    links = np.array([0, *(b[2] for b in found), 0], float) / np.maximum(words, 1)
    return np.stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]], axis=1)


#: Labelled blocks: the six features, and whether the block belongs to the article.
LABELLED = np.array(
    [
        # words, links; before; after; label. Text among text, short or long, also at the ends of a page.
        [2, 0.0, 0, 0.0, 0, 0.0, 1],
        [1, 0.0, 0, 0.0, 2, 0.0, 1],
        [2, 0.0, 1, 0.0, 1, 0.0, 1],
        [1, 0.0, 2, 0.0, 0, 0.0, 1],
        [9, 0.0, 0, 0.0, 120, 0.0, 1],
        [120, 0.0, 9, 0.0, 45, 0.05, 1],
        [45, 0.05, 120, 0.0, 3, 0.0, 1],
        [3, 0.0, 45, 0.05, 60, 0.0, 1],
        [60, 0.1, 3, 0.0, 14, 0.0, 1],
        [14, 0.2, 60, 0.1, 0, 0.0, 1],
        [33, 0.0, 12, 0.0, 8, 0.3, 1],
        [8, 0.3, 33, 0.0, 70, 0.0, 1],
        [5, 0.0, 4, 0.0, 6, 0.0, 1],
        [4, 0.25, 5, 0.0, 7, 0.0, 1],
        # Text beside links: a paragraph after a menu, a headline over a link list, a text before one.
        [85, 0.0, 1, 1.0, 40, 0.0, 1],
        [12, 0.0, 2, 1.0, 85, 0.0, 1],
        [2, 0.0, 1, 1.0, 30, 0.0, 1],
        [1, 0.0, 3, 1.0, 5, 0.0, 1],
        [40, 0.0, 66, 0.0, 2, 1.0, 1],
        [7, 0.0, 50, 0.0, 2, 1.0, 1],
        [3, 0.0, 20, 0.0, 4, 1.0, 1],
        [2, 0.0, 0, 0.0, 1, 1.0, 1],
        [1, 0.0, 1, 1.0, 0, 0.0, 1],
        [60, 0.0, 5, 1.0, 4, 1.0, 1],
        [25, 0.1, 1, 1.0, 1, 1.0, 1],
        [14, 0.0, 3, 1.0, 2, 1.0, 1],
        [9, 0.0, 1, 1.0, 2, 1.0, 1],
        [7, 0.1, 2, 1.0, 1, 0.9, 1],
        # Paragraphs with many links.
        [44, 0.5, 70, 0.0, 30, 0.0, 1],
        [26, 0.6, 12, 0.0, 3, 0.0, 1],
        [30, 0.55, 4, 1.0, 50, 0.0, 1],
        [20, 0.5, 28, 0.5, 24, 0.5, 1],
        [12, 0.5, 40, 0.0, 9, 0.0, 1],
        # A link of its own in the text: a linked headline, a source, a call in between.
        [6, 1.0, 70, 0.0, 44, 0.0, 1],
        [1, 1.0, 35, 0.0, 18, 0.0, 1],
        [4, 1.0, 90, 0.0, 6, 0.0, 1],
        [8, 1.0, 0, 0.0, 75, 0.0, 1],
        [3, 1.0, 0, 0.0, 2, 0.0, 1],
        [2, 1.0, 5, 0.0, 0, 0.0, 1],
        [5, 1.0, 60, 0.0, 0, 0.0, 1],
        [1, 1.0, 0, 0.0, 0, 0.0, 1],
        [15, 0.8, 9, 0.0, 22, 0.1, 1],
        [3, 1.0, 4, 0.0, 30, 0.0, 1],
        [2, 0.9, 3, 0.0, 8, 0.0, 1],
        # Menus and link lists: links beside links, at the start, in between and at the end.
        [1, 1.0, 0, 0.0, 1, 1.0, 0],
        [1, 1.0, 1, 1.0, 1, 1.0, 0],
        [2, 1.0, 1, 1.0, 3, 1.0, 0],
        [3, 1.0, 2, 1.0, 90, 0.0, 0],
        [1, 1.0, 1, 1.0, 7, 0.0, 0],
        [4, 1.0, 80, 0.0, 5, 1.0, 0],
        [2, 1.0, 6, 0.0, 2, 1.0, 0],
        [5, 1.0, 4, 1.0, 0, 0.0, 0],
        [8, 0.9, 9, 1.0, 7, 0.8, 0],
        [12, 1.0, 11, 1.0, 14, 1.0, 0],
        [7, 0.8, 40, 0.0, 9, 1.0, 0],
        [10, 0.9, 8, 0.9, 33, 0.0, 0],
        [25, 0.9, 3, 1.0, 30, 0.8, 0],
        [40, 0.95, 12, 1.0, 9, 1.0, 0],
        [6, 0.75, 5, 1.0, 4, 0.9, 0],
        [3, 1.0, 1, 0.0, 2, 1.0, 0],
        # Labels and marks between links, links between marks: menus in which not every entry is a link.
        [1, 0.0, 1, 1.0, 1, 1.0, 0],
        [1, 0.0, 2, 1.0, 3, 1.0, 0],
        [2, 0.0, 4, 1.0, 1, 1.0, 0],
        [2, 0.0, 1, 0.9, 2, 1.0, 0],
        [1, 1.0, 1, 0.0, 1, 0.0, 0],
        [2, 1.0, 1, 0.0, 1, 0.0, 0],
        [1, 1.0, 1, 0.0, 2, 0.0, 0],
    ]
)


@cache
def tree() -> tuple:
    """Decision tree of LABELLED: (feature, threshold, tree if <=, tree if >) or a leaf, by Gini impurity."""

    def grow(rows: np.ndarray):
        label = rows[:, -1]
        if label.min() == label.max():
            return int(label[0])
        best = None
        for f in (1, 3, 5, 0, 2, 4):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = rows[:, f] <= cut
                cost = sum(len(y) * y.mean() * (1 - y.mean()) for y in (label[left], label[~left]))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, cut, left)
        _, f, cut, left = best
        return f, float(cut), grow(rows[left]), grow(rows[~left])

    return grow(LABELLED)


def classify(x: np.ndarray, node=None) -> np.ndarray:
    """Which blocks belong to the article."""
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), bool(node))
    f, cut, low, high = node
    left = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(x[left], low), classify(x[~left], high)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, in page order, joined by two newlines."""
    found = [b[:3] for b in blocks(html or "") if b[3] != 1]
    if not found:
        return ""
    return "\n\n".join(b[0] for b, keep in zip(found, classify(features(found)), strict=True) if keep)


@F.pandas_udf(T.StringType())
def main_text_of(html: pd.Series) -> pd.Series:
    """``main_text`` of a column."""
    return html.map(main_text).astype(object)


def with_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text, the main text, and n_chars, its code points."""
    bounded_batches(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    text = main_text_of(F.coalesce(F.col(f"`{html_col}`"), F.lit("")))
    return pages.select(*others, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
