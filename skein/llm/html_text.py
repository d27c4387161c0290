"""Main text of web pages by a tree-structured graphical model.

Each block element and each run of text is a variable: 0 outside the main text, 1 around it, 2 in it. Unary potentials
come from tags, attribute words and shapes of text, pairwise potentials tie a node to its parent. Sum-product messages
up and down the tree give exact marginals, with which the weights are fitted to labelled pages by gradient ascent on
the likelihood, and by which runs of text are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches
from skein.llm.dom import Forest, attribute_words, levels
from skein.llm.layouts import labelled_pages
from skein.llm.text import per_text

BITS = 13
STATES = 3
OUTSIDE, AROUND, INSIDE = range(STATES)
#: Labelled pages that are learned from: all that are given up to this number, else so many made ones.
TRAIN_PAGES = 900
#: A page longer than this is labelled by nobody and not learned from; it is extracted like any other.
TRAIN_PAGE_CHARS = 1 << 18
#: Tags that share pairwise potentials with their parent; 0 is a run of text, and all others are the last kind.
_KINDS = [
    frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table tbody thead tfoot tr td th caption details summary".split()),
    frozenset("nav header footer aside form menu dialog fieldset".split()),
    frozenset("article main".split()),
]
KINDS = len(_KINDS) + 2


def kind_of(tag: str) -> int:
    return next((k for k, tags in enumerate(_KINDS, 1) if tag in tags), KINDS - 1)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - BITS)


def key_features(tag: str, attributes: str) -> np.ndarray:
    """Hashed features of an element: its tag, whole attribute words and their runs of four letters."""
    words = attribute_words(attributes) if attributes else []
    names = {f"t:{tag}", f"t:{tag}:{bool(words)}"}
    for w in words:
        names.add(f"w:{w}")
        names.update(f"g:{g}" for g in (f"^{w}$"[k : k + 4] for k in range(len(w) - 1)) if len(w) > 3)
    return np.unique(np.array([_slot(n) for n in names], np.int64))


def _bucket(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


@dataclass
class Graph:
    """Nodes of many pages that lead to text, with their features as (row, column) entries."""

    text: np.ndarray
    is_text: np.ndarray
    page: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    row: np.ndarray
    column: np.ndarray
    shapes: int  # so many of the first entries are shapes of texts

    def without_shapes(self, drop: np.ndarray) -> Graph:
        """The same graph, but the pages of `drop` show only their tags and names."""
        keep = (np.arange(len(self.row)) >= self.shapes) | ~drop[self.page[self.row]]
        return replace(self, row=self.row[keep], column=self.column[keep], shapes=int(keep[: self.shapes].sum()))


def graph_of(forest: Forest, cache: dict | None = None) -> Graph:
    cache = {} if cache is None else cache
    parent, depth = np.array(forest.parent, np.int64), np.array(forest.depth, np.int64)
    page, key = np.array(forest.page, np.int64), np.array(forest.key, np.int64)
    n = len(parent)
    is_text = np.fromiter((t is not None for t in forest.text), bool, n)
    chars = np.fromiter((len(t) if t else 0 for t in forest.text), np.float64, n)
    signs = np.fromiter((t.count(",") + t.count(".") + t.count("。") + t.count("、") if t else 0 for t in forest.text), np.float64, n)
    sums = np.stack([chars, np.array(forest.linked, np.float64), signs, is_text.astype(np.float64)], axis=1)
    # A node that leads to no text says nothing: it goes, so its text, if any, can't hang on it.
    for level in reversed(levels(depth)[1:]):
        np.add.at(sums, parent[level], sums[level])
    keep = sums[:, 3] > 0
    new = np.cumsum(keep) - 1
    sums, is_text, page, key, depth = sums[keep], is_text[keep], page[keep], key[keep], depth[keep]
    parent = np.where(parent[keep] >= 0, new[parent[keep]], -1)
    text = np.array(forest.text, object)[keep]
    total = np.bincount(page, sums[:, 0] * is_text, max(forest.pages, 1))
    count = np.bincount(page, is_text, max(forest.pages, 1))
    before = np.cumsum(is_text) - is_text
    first = np.zeros(len(count))
    first[1:] = np.cumsum(count)[:-1]
    place = (before - first[page]) / np.maximum(count[page], 1)
    size, link = sums[:, 0], sums[:, 1] / np.maximum(sums[:, 0], 1)
    sign = sums[:, 2] / np.maximum(size, 1)
    shapes = {
        "size": _bucket(size, [4, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120]),
        "link": _bucket(link, [0.001, 0.2, 0.4, 0.6, 0.8, 0.99]),
        "sign": _bucket(sign, [0.001, 0.006, 0.012, 0.02, 0.05]),
        "share": _bucket(size / np.maximum(total[page], 1), [0.01, 0.03, 0.1, 0.25, 0.5, 0.7, 0.9, 0.98]),
        "leaves": _bucket(sums[:, 3], [1.5, 2.5, 4.5, 8.5, 16.5, 32.5]),
        "mean": _bucket(size / np.maximum(sums[:, 3], 1), [5, 10, 20, 40, 80, 160, 320]),
        "place": _bucket(place, [0.05, 0.2, 0.4, 0.6, 0.8, 0.95]),
        "size and link": _bucket(size, [20, 80, 320, 1280]) * 4 + _bucket(link, [0.2, 0.5, 0.8]),
    }
    names = list(forest.keys)
    for pair in names:
        if pair not in cache:
            cache[pair] = (key_features(*pair), kind_of(pair[0]))
    kinds = np.array([cache[pair][1] for pair in names], np.int64)
    # The text of a paragraph has the paragraph's shape already; only other runs of text show one of their own.
    shaped = np.flatnonzero(~is_text | (kinds[key[np.maximum(parent, 0)]] != 1))
    rows, columns = [], []
    for name, value in shapes.items():
        table = np.array([[_slot(f"{name}:{kind}:{b}") for b in range(24)] for kind in ("element", "text")])
        rows.append(shaped)
        columns.append(table[is_text[shaped].astype(int), value[shaped]])
    n_shapes = sum(map(len, rows))
    own = [cache[pair][0] for pair in names]
    sizes = np.array([len(x) for x in own], np.int64)
    starts = np.cumsum(sizes) - sizes
    elements = np.flatnonzero(~is_text)
    k = key[elements]
    rows.append(np.repeat(elements, sizes[k]))
    steps = np.arange(int(sizes[k].sum())) - np.repeat(np.cumsum(sizes[k]) - sizes[k], sizes[k])
    columns.append(np.concatenate([np.zeros(0, np.int64), *own])[np.repeat(starts[k], sizes[k]) + steps])
    texts = np.flatnonzero(is_text)
    rows.append(texts)
    columns.append(np.full(len(texts), _slot("run of text")))
    kind = np.where(is_text, 0, kinds[key])
    return Graph(text, is_text, page, parent, kind, levels(depth), np.concatenate(rows), np.concatenate(columns), n_shapes)


@dataclass
class TreeModel:
    weights: np.ndarray  # (2**BITS, STATES)
    pairs: np.ndarray  # (KINDS, STATES of the parent, STATES of the child)

    def unary(self, g: Graph) -> np.ndarray:
        out = np.stack([np.bincount(g.row, self.weights[g.column, s], len(g.parent)) for s in range(STATES)], axis=1)
        out[g.is_text, AROUND] = -60.0  # a run of text is in or out
        return out

    def marginals(self, g: Graph, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(nodes x states, and for `edges` nodes x states of the parent x own states) by messages up and down every tree.

        Messages are probabilities up to a factor; a node's logarithms are summed over its children.
        """
        up = self.unary(g)
        ties = np.exp(self.pairs)
        sent = np.zeros_like(up)
        for level in reversed(g.levels[1:]):
            own = np.exp(up[level] - up[level].max(axis=1, keepdims=True))
            sent[level] = np.log((ties[g.kind[level]] @ own[:, :, None])[:, :, 0])
            np.add.at(up, g.parent[level], sent[level])
        belief = np.exp(up - up.max(axis=1, keepdims=True))
        joint = np.zeros((len(up), STATES, STATES)) if edges else None
        for depth, level in enumerate(g.levels):
            if depth:
                above = np.log(np.maximum(belief[g.parent[level]], 1e-300)) - sent[level]
                above = np.exp(above - above.max(axis=1, keepdims=True))
                both = above[:, :, None] * ties[g.kind[level]] * belief[level][:, None, :]
                both /= both.sum(axis=(1, 2), keepdims=True)
                if edges:
                    joint[level] = both
                belief[level] = both.sum(axis=1)
            else:
                belief[level] /= belief[level].sum(axis=1, keepdims=True)
        return belief, joint


def labels_of(g: Graph, lines: list[list[str]]) -> np.ndarray:
    """The state of each node, where `lines` are the blocks of each page's main text in order.

    Runs of text that are the next line are inside. The smallest element around all of them, and whatever in it leads
    to one, is inside; what is around that element is around; the rest is outside.
    """
    state = np.zeros(len(g.parent), np.int64)
    next_line = [0] * len(lines)
    for i in np.flatnonzero(g.is_text).tolist():
        own, at = lines[g.page[i]], next_line[g.page[i]]
        if at < len(own) and own[at] == g.text[i]:
            state[i] = INSIDE
            next_line[g.page[i]] += 1
    found = (state == INSIDE).astype(np.float64)
    wanted = np.bincount(g.page, found, len(lines))
    for level in reversed(g.levels[1:]):
        np.add.at(found, g.parent[level], found[level])
    whole = (found == wanted[g.page]) & (found > 0)
    holds_whole_child = np.zeros(len(whole), bool)
    holds_whole_child[g.parent[whole & (g.parent >= 0)]] = True
    some = (found > 0) & ~g.is_text
    state[some] = np.where(whole & holds_whole_child, AROUND, INSIDE)[some]
    # One run alone makes its element the smallest around it.
    single = holds_whole_child & ~np.isin(np.arange(len(whole)), g.parent[whole & ~g.is_text])
    state[some & single] = INSIDE
    return state


def fit(g: Graph, state: np.ndarray, steps: int = 60, rate: float = 0.15, l2: float = 0.1) -> TreeModel:
    """Maximum likelihood: observed less expected counts of features and of pairs of states, by Adam."""
    model = TreeModel(np.zeros((1 << BITS, STATES)), np.zeros((KINDS, STATES, STATES)))
    child = np.flatnonzero(g.parent >= 0)
    seen = np.eye(STATES)[state]
    seen_pairs = np.zeros((len(state), STATES, STATES))
    seen_pairs[child, state[g.parent[child]], state[child]] = 1
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.pairs)]
    scale = 1.0 / max(1, int(g.page.max()) + 1 if len(g.page) else 1)
    for step in range(1, steps + 1):
        own, joint = model.marginals(g, edges=True)
        miss = seen - own
        slope = np.stack([np.bincount(g.column, miss[g.row, s], 1 << BITS) for s in range(STATES)], axis=1)
        pair_slope = np.zeros_like(model.pairs)
        np.add.at(pair_slope, g.kind[child], seen_pairs[child] - joint[child])
        for x, s, (m, v) in zip((model.weights, model.pairs), (slope, pair_slope), moments, strict=True):
            s = (s - l2 * x) * scale
            m += 0.1 * (s - m)
            v += 0.02 * (s * s - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-4)
    return model


def train_extractor(pages: DataFrame | None = None, limit: int = TRAIN_PAGES, html_col: str = "html", text_col: str = "text", seed: int = 1) -> TreeModel:
    """A model of `pages`, whose text column has the main text, a block a line; without any, of made pages.

    At most about `limit` pages that a hash of their html chooses reach the driver, none over `TRAIN_PAGE_CHARS`.
    Rows without html or text are left out; a page with an empty text is one without main text.
    """
    if pages is None:
        rows = labelled_pages(limit, seed)
    else:
        known = pages.select(F.col(html_col).alias("h"), F.col(text_col).alias("t")).filter(F.col("h").isNotNull() & F.col("t").isNotNull() & (F.length("h") <= TRAIN_PAGE_CHARS))
        rows = [(r["h"], r["t"]) for r in known.orderBy(F.xxhash64("h", F.lit(seed)), "h", "t").limit(limit).collect()]
    model = TreeModel(np.zeros((1 << BITS, STATES)), np.zeros((KINDS, STATES, STATES)))
    forest = Forest()
    for page, _ in rows:
        forest.add(page)
    if rows:
        g = graph_of(forest)
        # A third of the pages are learned from by tags and names alone, so that these count beside the shapes of texts.
        g = g.without_shapes(np.arange(forest.pages) % 3 == 0)
        model = fit(g, labels_of(g, [text.split("\n") if text else [] for _, text in rows]))
    return TreeModel(model.weights.astype(np.float32), model.pairs.astype(np.float32))


def extract(pages: list[str], model: TreeModel, cache: dict | None = None, threshold: float = 0.5) -> list[str]:
    """The main text of each page: the runs of text that are inside by their marginal, a line each."""
    forest = Forest()
    for page in pages:
        forest.add(page)
    out: list[list[str]] = [[] for _ in pages]
    g = graph_of(forest, cache)
    if len(g.parent):
        inside = g.is_text & (model.marginals(g)[0][:, INSIDE] >= threshold)
        for p, t in zip(g.page[inside].tolist(), g.text[inside].tolist(), strict=True):
            out[p].append(t)
    return ["\n".join(lines) for lines in out]


def main_text(html: Column, model: TreeModel) -> Column:
    """The main text of a column of whole pages; a null page counts as empty and gives an empty text."""

    def load() -> Callable[[list[bytes]], pa.Array]:
        cache: dict = {}

        def work(pages: list[bytes]) -> pa.Array:
            if len(cache) > 50_000:
                cache.clear()
            return pa.array(extract([p.decode("utf-8", "replace") for p in pages], model, cache), pa.string())

        return work

    return per_text(html, "string", load, 1 << 20)


def extract_pages(pages: DataFrame, model: TreeModel | None = None, carry: tuple[str, ...] | None = None, html_col: str = "html") -> DataFrame:
    """`pages` as a struct `page` (all columns, or `carry`), its main text and that text's number of code points.

    Null and empty pages, and pages without a main text, give an empty text. Rows stand for themselves, whatever
    their ids. A run of text is the characters between the borders of block elements; white space in it is one space.
    """
    bounded_batches(pages.sparkSession)
    made = pages.select(F.struct(*(carry or ["*"])).alias("page"), main_text(F.col(html_col), model or train_extractor()).alias("text"))
    return made.select("page", "text", F.char_length("text").cast("long").alias("n_chars"))
