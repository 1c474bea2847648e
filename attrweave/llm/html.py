"""Main-content extraction from HTML by gradient-boosted trees over DOM nodes.

A page is read once into arrays of its nodes (parent, depth, order, tag, attribute tokens, characters of text and of text
in links, tags below). Each node has features of its subtree (text density, link density, punctuation, size), its
attributes (hashed tokens of class and id and of the tag), its depth and its siblings. Trees boosted on the logistic loss,
trained here by histograms of quantiles, give each node the log-odds that its text is main content.

Hierarchical decoding. Every text belongs to a node; a choice marks a set of nodes none of which is an ancestor of
another, and each takes its whole subtree. From the leaves up, a node is taken as a whole if its score times its text
outweighs the best choice below it; the best choice of the root is what is extracted, so an ancestor and a descendant can
never contradict each other. Scripts, styles and comments are no text.

Labels come from a table of the pages' true texts: a node is content if most of its words are the text's. The trees are fitted
on TRAIN_PAGES different pages of TRAIN_LETTERS letters at most, which is the documented bound of the sample; every page is then extracted whole.

Edge cases: a null or empty page, and one without text, gives an empty text; unclosed, stray and crossed tags are tolerated
as browsers do, roughly: an end tag closes the nearest open element of its name, if any, and a tag that never closes is text;
pages as long as memory allows, in time proportional to their length, without recursion; repeated rows and ids are extracted alike; without any labelled page nothing is content, and
every text is empty; an empty table gives an empty table; only the named columns are read, so further columns of any name
do no harm.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import slices, text_of

#: Pages that the trees are fitted on, at most, picked by a hash of the id.
TRAIN_PAGES = 400
#: Letters of a page, and of a true text, beyond which it isn't fitted on, so that the sample's size is bounded.
TRAIN_LETTERS = 200_000
TREES, LEVELS, RATE, BINS = 40, 4, 0.2, 32
HASHED = 16  # features of attribute and tag tokens

# Possessive, so that a token is matched in one pass or not at all.
_TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_RAW = re.compile(r"<(script|style|noscript|template)\b[^>]*+>", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template")}
_SPECIAL = re.compile("[>\"']")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the value's names closes an open element of the key.
_CLOSES = {
    "p": frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 article section nav footer header aside form pre blockquote".split()),
    "li": frozenset(["li"]),
    "td": frozenset("td th tr".split()),
    "th": frozenset("td th tr".split()),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
    "dt": frozenset("dt dd".split()),
    "dd": frozenset("dt dd".split()),
}
_BLOCK = frozenset("p div ul ol li table tr h1 h2 h3 h4 h5 h6 article section nav footer header aside form pre blockquote br body title main dl dt dd td th".split())
_SKIP = frozenset("head title".split())


@dataclass
class Dom:
    parent: list[int]
    tag: list[str]
    attributes: list[str]
    pieces: list[tuple[int, str]]  # the node that a text belongs to, and the text, in order
    spaced: set[int] = field(default_factory=set)  # pieces with a text of white space alone, which is no piece, before them


def _text(raw: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", raw))


def _closed(page: str) -> tuple[list[int], list[bool]]:
    """The places of quotes and > in a page, and whether a tag that goes on there, outside quotes, is closed.

    From the end: a > closes, a quote passes on what holds after the next one like it.
    """
    places = [m.start() for m in _SPECIAL.finditer(page)]
    closed, after = [False] * (len(places) + 1), {}
    for k in range(len(places) - 1, -1, -1):
        letter = page[places[k]]
        closed[k] = letter == ">" or (letter in after and closed[after[letter] + 1])
        if letter != ">":
            after[letter] = k
    return places, closed


def _tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag or None) of what isn't text, each character read a fixed number of times."""
    at, last, places, closed = 0, page.rfind(">"), None, []
    while 0 <= (i := page.find("<", at)) and i + 1 < len(page):
        kind = page[i + 1]
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            yield i, at, None
        elif i > last:
            continue  # nothing closes any more, but a comment still ends with the page
        elif kind in "!?":
            at = page.index(">", i) + 1
            yield i, at, None
        elif kind in "sSnNtT" and (m := _RAW.match(page, i)):
            end = _RAW_END[m[1].lower()].search(page, m.end())
            at = end.end() if end else len(page)
            yield i, at, None
        elif kind == "/" or kind.isalpha():
            # After the first tag that never closes, a look at what closes comes before the match.
            if places is not None and not closed[bisect_right(places, i)]:
                continue
            if m := _TOKEN.match(page, i):
                at = m.end()
                yield i, at, m
            elif places is None:
                places, closed = _closed(page)


def parse(page: str) -> Dom:
    """The nodes of a page, the root first, parents before children."""
    parent, tag, attributes, pieces, spaced = [-1], ["#root"], [""], [], set()
    open_, halt, where, at = [0], [0], {}, 0  # halt: the nearest open element, from each down, that may end or stop an end

    def end_from(k: int) -> None:
        while len(open_) > k:
            where[tag[open_.pop()]].pop()
            halt.pop()

    for start, end, m in _tokens(page):
        if start > at and page[at:start].isspace():
            spaced.add(len(pieces))
        elif start > at:
            pieces.append((open_[-1], _text(page[at:start])))
        at = end
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            if where.get(name):
                end_from(where[name][-1])
            continue
        # An open element that this one can't be in ends, with the inline elements still open in it.
        k = halt[-1]
        while k > 0:
            if name in _CLOSES.get(tag[open_[k]], ()):
                end_from(k)
            elif tag[open_[k]] in _BLOCK:
                break
            k = halt[k - 1]
        parent.append(open_[-1])
        tag.append(name)
        attributes.append(m[3])
        if name not in _VOID and not m[3].endswith("/"):
            where.setdefault(name, []).append(len(open_))
            halt.append(len(open_) if name in _BLOCK or name in _CLOSES else halt[-1])
            open_.append(len(tag) - 1)
    if at < len(page) and not page[at:].isspace():
        pieces.append((open_[-1], _text(page[at:])))
    return Dom(parent, tag, attributes, pieces, spaced)


_hashed: dict[str, int] = {}


def _slot(token: str) -> int:
    slot = _hashed.get(token)
    if slot is None:
        if len(_hashed) > 100_000:
            _hashed.clear()
        slot = _hashed[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % HASHED
    return slot


def _below(parent: np.ndarray, depth: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums over subtrees, level by level from the deepest."""
    total = own.astype(np.float64).copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        if depth[level[0]] == 0:
            break
        np.add.at(total, parent[level], total[level])
    return total


def features(dom: Dom) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, features), and characters of text below each node."""
    n = len(dom.parent)
    parent = np.array(dom.parent)
    depth = [0] * n
    for k in range(1, n):
        depth[k] = depth[dom.parent[k]] + 1
    depth = np.array(depth)
    own = np.zeros((n, 5))  # characters, words, punctuation, characters in links, nodes
    own[:, 4] = 1
    linked = np.zeros(n, dtype=bool)
    for k in range(1, n):
        linked[k] = dom.tag[k] == "a" or linked[dom.parent[k]]
    for node, text in dom.pieces:
        words = text.count(" ") + 1
        marks = text.count(",") + text.count(".")
        own[node, 0] += len(text)
        own[node, 1] += words
        own[node, 2] += marks
        if linked[node]:
            own[node, 3] += len(text)
    below = _below(parent, depth, own)
    whole = np.maximum(below[0], 1)
    ratio = lambda a, b: a / np.maximum(b, 1)
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    up = np.maximum(parent, 0)
    place = np.zeros(n)
    seen: dict[int, int] = {}
    for k in range(1, n):
        place[k] = seen[dom.parent[k]] = seen.get(dom.parent[k], -1) + 1
    siblings = children[up]
    mean = (below[up, 0] - own[up, 0]) / np.maximum(siblings, 1)
    slots = np.zeros((n, HASHED), dtype=np.float64)
    for k in range(1, n):
        slots[k, _slot(dom.tag[k])] = 1
        if "=" in dom.attributes[k]:
            for m in _ATTRIBUTE.finditer(dom.attributes[k]):
                for token in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
                    slots[k, _slot("@" + token)] = 1
    columns = [
        np.log1p(below[:, 0]), ratio(below[:, 0], below[:, 4]), ratio(below[:, 3], below[:, 0]), ratio(below[:, 2], below[:, 1]),
        below[:, 0] / whole[0], np.log1p(own[:, 0]), np.log1p(below[:, 4]), depth, children, siblings, ratio(place, siblings),
        np.log1p(mean), np.log1p(below[:, 0]) - np.log1p(mean), below[up, 0] / whole[0], ratio(below[up, 3], below[up, 0]), np.log1p(below[:, 1]),
    ]
    above = np.where((parent >= 0)[:, None], slots[up], 0)  # the parent's tokens as well
    return np.column_stack([*columns, slots, above]), below[:, 0]


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (2**LEVELS - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Trees of LEVELS levels by second-order steps on the logistic loss, over BINS quantiles of each feature."""
    n, count = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(count)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), 2**LEVELS - 1
    found = Trees(base, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-12
        at = np.zeros(n, dtype=np.int64)
        for level in range(LEVELS):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, where = np.zeros(width), np.full((width, 2), -1)
            for k in range(count):
                if not len(edges[k]):
                    continue
                slot = local * BINS + binned[:, k]
                gs, hs = (np.cumsum(np.bincount(slot, v, width * BINS).reshape(width, BINS), axis=1) for v in (g, h))
                gain = gs[:, :-1] ** 2 / (hs[:, :-1] + ridge) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain = gain[:, : len(edges[k])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[better, top[better]]
                where[better] = np.column_stack([np.full(better.sum(), k), top[better]])
            for node in range(width):
                k, b = where[node]
                if k >= 0:
                    found.feature[t, first + node], found.cut[t, first + node] = k, edges[k][b]
            at = 2 * at + 1 + (x[np.arange(n), found.feature[t][at]] > found.cut[t][at])
        leaf = at - inner
        found.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += found.leaf[t][leaf]
    return found


def decode(dom: Dom, score: np.ndarray, size: np.ndarray) -> list[int]:
    """The nodes that are taken: no two of them one below the other, and of the greatest sum of score times text."""
    n = len(dom.parent)
    value = np.where(np.isin(dom.tag, list(_SKIP)), -np.inf, score * np.log1p(size))
    value[size == 0] = 0
    best, value = [0.0] * n, value.tolist()
    taken = bytearray(n)
    for k in range(n - 1, -1, -1):  # children come after their parents
        if value[k] > 0 and value[k] >= best[k]:
            best[k], taken[k] = value[k], 1
        if k:
            best[dom.parent[k]] += best[k]
    out, inside = [], bytearray(n)
    for k in range(n):
        if k and inside[dom.parent[k]]:
            inside[k] = 1
        elif taken[k]:
            inside[k] = 1
            out.append(k)
    return out


def text_below(dom: Dom, nodes: list[int]) -> str:
    """The texts below the nodes, in order; a line for each block."""
    inside, block = bytearray(len(dom.parent)), list(range(len(dom.parent)))
    for k in nodes:
        inside[k] = 1
    for k in range(1, len(dom.parent)):
        inside[k] |= inside[dom.parent[k]]
        if dom.tag[k] not in _BLOCK:
            block[k] = block[dom.parent[k]]
    lines: list[list[str]] = []
    last, space = -1, False
    for k, (node, text) in enumerate(dom.pieces):
        space |= k in dom.spaced
        if inside[node]:
            if block[node] == last:
                lines[-1] += [" ", text] if space else [text]
            else:
                lines.append([text])
                last = block[node]
            space = False
    return "\n".join(x for line in lines if (x := " ".join("".join(line).split())))


def label(dom: Dom, truth: str) -> np.ndarray:
    """Of each node: whether most of the words below it are words of the true text."""
    words = set(truth.split())
    parent, depth = np.array(dom.parent), [0] * len(dom.parent)
    for k in range(1, len(dom.parent)):
        depth[k] = depth[dom.parent[k]] + 1
    own = np.zeros((len(parent), 2))
    for node, text in dom.pieces:
        found = text.split()
        own[node] += len(found), sum(w in words for w in found)
    below = _below(parent, np.array(depth), own)
    return (below[:, 1] > 0.9 * below[:, 0]) & (below[:, 0] > 0)


def fit(rows: list[tuple[str, str]]) -> Trees | None:
    """Trees of (page, true text) rows."""
    xs, ys, ws = [], [], []
    for page, truth in rows:
        dom = parse(page)
        x, size = features(dom)
        xs.append(x)
        ys.append(label(dom, truth))
        ws.append(np.where(size > 0, 1.0, 0.05))
    if not xs:
        return None
    return boost(np.concatenate(xs), np.concatenate(ys).astype(np.float64), np.concatenate(ws))


def train(pages: DataFrame, texts: DataFrame, link: Column, text_key: str = "doc_id", most: int = TRAIN_PAGES) -> Trees | None:
    """Fits on `most` pages at most of those with a text, the least by a hash of the page.

    link: an expression over pages that gives the text_key of the page's true text, or null.
    """
    linked = pages.filter(F.length("html") <= TRAIN_LETTERS).select(link.cast("long").alias("k"), F.xxhash64(F.lit("html"), F.col("html")).alias("r"), F.col("html").alias("h")).filter("k is not null")
    # The least hashes come first, each page's copies as one, so that only the sample's pages and texts travel.
    drawn = linked.groupBy("r").agg(F.min("k").alias("k")).orderBy("r").limit(most).collect()
    if not drawn:
        return None
    named = {x[0]: x[1] for x in drawn}
    page = {(x[0], x[1]): x[2] for x in linked.filter(F.col("r").isin(list(named)) & F.col("k").isin(list(named.values()))).dropDuplicates(["k", "r"]).select("k", "r", "h").collect() if named[x[1]] == x[0]}
    truth = {x[0]: x[1] for x in texts.filter(F.col(text_key).isin(list(named.values())) & (F.length("text") <= TRAIN_LETTERS)).dropDuplicates([text_key]).select(F.col(text_key).cast("long"), "text").collect()}
    return fit([(page[k], truth[k[0]]) for k in sorted(page) if k[0] in truth])


def extract_page(page: str, trees: Trees | None) -> tuple[str, int]:
    """The main text of a page, and how many nodes were taken."""
    if not page or trees is None:
        return "", 0
    dom = parse(page)
    if not dom.pieces:
        return "", 0
    x, size = features(dom)
    nodes = decode(dom, trees.score(x), size)
    return text_below(dom, nodes), len(nodes)


def extract(pages: DataFrame, trees: Trees | None, key: str = "page_id", column: str = "html") -> DataFrame:
    """Columns key, text, nodes (taken): a row for each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # of a size fixed by TREES and LEVELS
    source = pages.select(F.col(key), text_of(pages, column).alias("__aw_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__aw_html"):
            found = [extract_page(p, shared.value) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], names=[key, "text", "nodes"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, text string, nodes int")
