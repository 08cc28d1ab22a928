"""Operator 1: main text of web pages, from flat text blocks that a decision tree classifies.

A page becomes a flat list of text blocks (block-level tags end a block; inline tags do not). Each block has its word
count and link density, the same two of its neighbours, and one hint, the place that markup gives it: 1 inside an
article or main element, 2 in a paragraph there, -2 inside an element that is made for other things (menu, aside, footer,
form, comment thread, hidden, or with a class or id that is or begins with the name of a notice or advert), -1 where a
class or id is another such name ("sidebar"), -0.5 where a name is only part of one, 0 elsewhere. A decision tree fitted to a small table of labelled blocks keeps or drops each block. Link density and words
head the tree; the hint decides only among blocks that these leave open.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
left out, and the kept ones joined by one line feed in page order. ``<br>`` is white space. Nothing is cut.

Defined results: a null or empty html gives the empty text; pages without a kept block give the empty text; null
page_id or url stay null; repeated rows stay repeated; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import table

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "hint"]

#: Labelled blocks, a family of similar ones a line: label (1 main text), hint and link density; numbers of words; and
#: neighbourhoods (words and link density before, words and link density after).
LABELLED = """
0 -2 1.0 | 1 4 9 | 0 0 4 1; 4 1 5 1; 60 0 3 1; 5 1 0 0
0 0 0.9 | 1 5 14 30 | 0 0 4 1; 5 1 4 0.9; 3 0 6 1; 70 0 5 1; 60 0 60 0; 90 0 0 0
0 0 0.5 | 3 14 30 | 6 1 8 0.7; 80 0 0 0; 22 0.3 3 1; 60 0 60 0
0 1 0.9 | 2 5 9 20 | 50 0 4 1; 4 1 40 0; 60 0 60 0; 3 0 3 0; 6 1 5 1
0 1 0.5 | 2 5 9 20 | 50 0 4 1; 4 1 40 0; 60 0 60 0; 3 0 3 0; 6 1 5 1
0 -0.5 0.8 | 3 8 30 | 40 0 70 0; 5 1 5 1
0 2 0.9 | 1 2 3 | 50 0 4 1; 4 1 40 0; 60 0 60 0; 3 0 3 0; 6 1 5 1
1 2 0.9 | 5 8 14 40 | 50 0 4 1; 4 1 40 0; 60 0 60 0; 3 0 3 0; 6 1 5 1
1 2 0.5 | 2 5 9 20 60 | 50 0 4 1; 4 1 40 0; 60 0 60 0; 3 0 3 0; 6 1 5 1
1 2 0 | 1 2 4 7 12 25 60 150 | 1 1 0 0; 5 1 3 1; 1 1 80 0; 6 1 8 0; 40 0 44 0; 1 0 2 0; 70 0 5 1; 12 0 60 0; 90 0 0 0; 3 0 5 0; 4 0 0 0; 2 0 20 0; 2 0 4 1; 1 0 3 0.6
0 -1 0.5 | 3 8 30 | 40 0 70 0; 5 1 5 1
0 -2 0 | 2 5 9 16 30 60 | 60 0 0 0; 4 1 5 1; 100 0 20 0; 8 0 70 0
0 -1 0 | 2 4 8 14 24 40 | 1 1 8 0; 9 0 11 0; 60 0 55 0; 100 0 0 0
1 -1 0 | 50 70 95 150 | 70 0 60 0; 90 0 120 0; 75 0 6 0; 12 0 80 0
1 1 0 | 1 2 4 7 12 25 60 150 | 1 1 0 0; 5 1 3 1; 1 1 80 0; 6 1 8 0; 40 0 44 0; 1 0 2 0; 70 0 5 1; 12 0 60 0; 90 0 0 0; 3 0 5 0; 4 0 0 0; 2 0 20 0; 2 0 4 1; 1 0 3 0.6
1 1 0.2 | 7 60 150 | 44 0 15 0; 95 0 1 0; 3 0 4 0
1 -0.5 0 | 6 9 12 | 6 1 60 0; 80 0 40 0; 8 0 70 0; 70 0 4 1
1 -0.5 0 | 25 45 90 | 9 0 45 0; 40 0 4 1; 80 0 70 0
0 -0.5 0 | 3 5 8 | 3 1 4 0.8; 2 1 3 0.5; 6 1 8 0
0 0 0 | 2 4 6 8 | 7 1 5 1; 1 1 3 0; 3 1 5 0; 1 1 9 0; 5 1 0 0; 2 0 4 0.5; 9 0.9 4 0.7
1 0 0 | 3 6 9 | 5 1 30 0; 4 1 90 0; 40 0 70 0; 55 0 25 0; 8 0 60 0
1 0 0 | 5 8 12 20 | 60 0 3 1; 45 0 2 1; 70 0 5 1
1 0 0 | 18 32 75 150 | 10 0 50 0; 75 0 3 1; 4 1 35 0; 32 0 2 1; 60 0 45 0; 0 0 0 0; 6 1 4 1; 3 0 5 0
"""

#: Elements whose content is no text of the page.
_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|select|textarea|button|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<[!?][^>]*>?|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)[^>]*>?",
    re.DOTALL | re.IGNORECASE,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AWAY = frozenset("nav aside footer form dialog menu fieldset".split())
_THREAD = frozenset("comment comments respond replies disqus commentlist".split())
_OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs header masthead footer share sharing social related recommended widget toolbar pagination pager login search".split()
)
#: Of these names, those of notices and adverts: what they begin is no article's text however long.
_NOTICES = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup".split())
#: Before a thread's name these say that an element has comments, not that it is them.
_HAVING = frozenset("has with without no open show hide enable allow post article page entry".split())
_WORDS = re.compile(r"[a-z0-9]+")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _named(attributes: str) -> tuple[bool, float]:
    """(whether a class or id names a comment thread, the hint of its names: -2, -1, -0.5 or 0)."""
    hint = 0.0
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORDS.findall(name)
            if words and any(w in _THREAD for w in words) and words[0] not in _HAVING:  # "comments", "user-comments"
                return True, -1.0
            others = sum(w in _OTHERS for w in words)
            if words and words[0] in _NOTICES:
                hint = -2.0
            elif others:  # "share-box" is one, "post-header" and "text-share-price" may be
                hint = min(hint, -1.0 if others == len(words) or words[0] in _OTHERS else -0.5)
    return False, hint


def _region(tag: str, attributes: str, above: tuple[float, bool]) -> tuple[float, bool]:
    """(hint, whether nothing inside can end it) of an element whose parent has ``above``."""
    hint, firm = above
    if firm or tag in ("html", "body"):
        return above
    thread, named = _named(attributes) if attributes else (False, 0.0)
    if tag in _AWAY or thread or attributes and _UNSEEN.search(attributes):
        return -2.0, True
    if tag in ("article", "main"):
        return 1.0, False
    if tag == "header" and hint != 1:
        return -1.0, False
    if not named:
        return above
    if hint == 1 and named == -0.5:  # a part of a name says nothing inside an article
        return above
    return min(hint, named), False


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """The page's text blocks in order: text, words, words in links, hint."""
    out: list[tuple[str, int, int, float]] = []
    stack: list[tuple[str, tuple[float, bool]]] = []
    state, parts, links, in_link, at, in_head = (0.0, False), [], 0, False, 0, False
    paragraph = None  # the state of a paragraph with attributes of its own: it ends with its block

    def end_block() -> None:
        nonlocal parts, links, paragraph
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(links, len(words)), (paragraph or state)[0]))
        parts, links, paragraph = [], 0, None

    def add(text: str) -> None:
        nonlocal links
        if text and not in_head:
            parts.append(text)
            if in_link:
                links += len(text.split())

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), bool(m[2]), m[4]
        if tag == "a":
            in_link = not closing
        if tag == "br":
            parts.append(" ")
        if tag in _INLINE or tag == "br":
            continue
        end_block()
        if tag == "head":
            in_head = not closing
        elif tag == "body":
            in_head = False
        if tag == "p" and not closing:
            paragraph = _region(tag, attributes, state)
            if paragraph[0] == 1:
                paragraph = 2.0, False
        if tag in _VOID or tag in ("p", "head", "html", "body"):
            continue
        if not closing:
            if not attributes.rstrip().endswith("/"):
                stack.append((tag, state))
                state = _region(tag, attributes, state)
        elif any(t == tag for t, _ in stack):
            while True:  # what stands open inside ends with it
                t, state = stack.pop()
                if t == tag:
                    break
    add(page[at:])
    end_block()
    return out


def block_features(found: list[tuple[str, int, int, float]]) -> np.ndarray:
    if not found:
        return np.empty((0, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found]) / words
    pad = np.zeros(1)
    return np.column_stack([words, density, np.concatenate([pad, words[:-1]]), np.concatenate([pad, density[:-1]]), np.concatenate([words[1:], pad]), np.concatenate([density[1:], pad]), [b[3] for b in found]])


Node = tuple[int, float, "Node", "Node"] | int


def fit_tree(x: np.ndarray, y: np.ndarray, max_depth: int = 8) -> Node:
    """A binary classification tree by Gini impurity; (feature, threshold, tree where at most it, tree where over) or a class."""
    ones = int(y.sum())
    if max_depth == 0 or ones in (0, len(y)):
        return int(2 * ones >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            cost = sum(n * p * (1 - p) for n, p in ((left.sum(), y[left].mean()), ((~left).sum(), y[~left].mean())))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return int(2 * ones >= len(y))
    _, f, t, left = best
    return f, t, fit_tree(x[left], y[left], max_depth - 1), fit_tree(x[~left], y[~left], max_depth - 1)


def decide(tree: Node, row) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def labelled_blocks(families: str = LABELLED) -> np.ndarray:
    """The table's rows: ``FEATURES``, then the label."""
    rows = []
    for line in families.strip().splitlines():
        head, words, near = line.split("|")
        label, hint, density = (float(v) for v in head.split())
        rows += [[float(n), density, *(float(v) for v in around.split()), hint, label] for n in words.split() for around in near.split(";")]
    return np.array(rows)


def train(families: str = LABELLED) -> Node:
    """The tree for a table of labelled blocks."""
    rows = labelled_blocks(families)
    return fit_tree(rows[:, :-1], rows[:, -1].astype(int))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, block_features(found).tolist(), strict=True) if decide(tree, row))


def _extract(tree: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(tree or train()), "page_id long, url string, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
