"""HTML extraction (operator 5): a tree-structured graphical model over the block elements of a page.

Each element is content or not. Its own potential is a sum over its features (tag, names in class, id and role, how much
text it and what is below it hold, and how much of that is linked); the potential of an edge depends on both states
and the kind of the child. Sum-product messages go up from the leaves and down from the root, level by level for many
pages at once, and give each element's marginal. Weights are fitted by gradient ascent on the likelihood of labelled
pages (``dom.labelled_pages``: PAGES of them from a fixed seed, in many layouts), with the same messages.

The text of a page is that of the elements whose marginal is at least one half. Null, empty and damaged pages are read
as far as they go and give an empty text if nothing is left. Pages are independent and read in the tasks that hold
them; repeated rows are read each, other columns pass through, ones named like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import append
from .dom import Page, labelled_pages

PAGES, SEED, STEPS, RATE, SHRINK = 200, 5, 100, 0.15, 2e-6
TAGS = (
    "#page html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption "
    "nav header footer aside form button select fieldset details address"
).split()
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption address".split())
BOXES = set("#page html body main article section div ul ol dl table tr figure".split())
TAG = {t: i for i, t in enumerate(TAGS)}
NAMES = 512
AMOUNTS = (0, 10, 40, 150, 600)
SHARES = (0.05, 0.3, 0.7)
#: An element inside one of these; the nearest counts.
AROUND = ("#page", "article", "main", "nav", "header", "footer", "aside", "form")
_TAG, _OWN, _ALL, _LINK, _AROUND, _NAME = np.cumsum([0, len(TAGS) + 1, len(AMOUNTS) + 1, len(AMOUNTS) + 1, len(SHARES) + 2, len(AROUND)])
FEATURES = int(_NAME) + NAMES


class Forest:
    """Trees of several pages in one array; level by level the elements of that depth and their parents."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        self.begin = np.r_[0, np.cumsum(sizes)]
        shift = np.repeat(self.begin[:-1], sizes)
        flat = lambda name: np.concatenate([np.asarray(getattr(p, name)) for p in pages])
        self.parent = flat("parent") + shift
        depth = flat("depth")
        tags = [t for p in pages for t in p.tag]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.kind = np.array([0 if t in TEXTUAL else 1 if t in BOXES else 2 for t in tags])
        own, linked = flat("chars"), flat("linked")
        total, total_linked = own.copy(), linked.copy()
        for level in reversed(self.levels):
            np.add.at(total, self.parent[level], total[level])
            np.add.at(total_linked, self.parent[level], total_linked[level])
        n = len(tags)
        around = np.array([AROUND.index(t) if t in AROUND else -1 for t in tags])
        for level in self.levels:
            around[level] = np.where(around[level] > 0, around[level], around[self.parent[level]])
        share = np.searchsorted(SHARES, total_linked / np.maximum(total, 1), side="right") + (total > 0)
        columns = [
            _TAG + np.array([TAG.get(t, len(TAGS)) for t in tags]), _OWN + np.searchsorted(AMOUNTS, own, side="left"),
            _ALL + np.searchsorted(AMOUNTS, total, side="left"), _LINK + share, _AROUND + around,
        ]
        named = [(i, zlib.crc32(w.encode()) % NAMES) for i, ws in enumerate(w for p in pages for w in p.names) for w in ws]
        extra = np.array(named, dtype=np.int64).reshape(-1, 2)
        self.row = np.r_[np.tile(np.arange(n), len(columns)), extra[:, 0]]
        self.feature = np.r_[np.concatenate(columns), _NAME + extra[:, 1]].astype(np.int64)
        self.n = n


def marginals(f: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(state) of each element, P(state of parent, state) of each edge, and the log of the sum over all states.

    ``node``: weight of content for each feature; ``edge``: kind x parent's state x state.
    """
    own = np.zeros((f.n, 2))
    own[:, 1] = np.bincount(f.row, node[f.feature], f.n)
    pair = edge[f.kind]
    up, message = own.copy(), np.zeros((f.n, 2))
    for level in reversed(f.levels):
        message[level] = np.logaddexp.reduce(pair[level] + up[level][:, None, :], axis=2)
        np.add.at(up, f.parent[level], message[level])
    roots = f.begin[:-1]
    total = np.logaddexp.reduce(up[roots], axis=1)
    down = np.zeros((f.n, 2))  # of each element, the log of its marginal without what is below it, up to a constant
    belief = up.copy()
    for level in f.levels:
        above = belief[f.parent[level]] - message[level]
        down[level] = np.logaddexp.reduce(pair[level] + above[:, :, None], axis=1)
        belief[level] = up[level] + down[level]
        belief[level] -= belief[level].max(axis=1, keepdims=True)
    p = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
    joint = np.zeros((f.n, 2, 2))
    for level in f.levels:
        above = belief[f.parent[level]] - message[level]
        x = above[:, :, None] + pair[level] + up[level][:, None, :]
        x = np.exp(x - x.max(axis=(1, 2), keepdims=True))
        joint[level] = x / x.sum(axis=(1, 2), keepdims=True)
    return p, joint, float(total.sum())


def fit(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and edges from pages with labels."""
    pages = [Page(s, labelled=True) for s in sources]
    f, label = Forest(pages), np.concatenate([p.label for p in pages])
    node, edge = np.zeros(FEATURES), np.zeros((3, 2, 2))
    child = np.concatenate(f.levels) if f.levels else np.zeros(0, int)
    seen = np.bincount(f.feature, label[f.row], FEATURES)
    seen_edge = np.zeros_like(edge)
    np.add.at(seen_edge, (f.kind[child], label[f.parent[child]], label[child]), 1)
    m = [np.zeros_like(node), np.zeros_like(edge)]
    s = [np.zeros_like(node), np.zeros_like(edge)]
    for t in range(1, STEPS + 1):
        p, joint, _ = marginals(f, node, edge)
        expected_edge = np.zeros_like(edge)
        np.add.at(expected_edge, f.kind[child], joint[child])
        g = [(seen - np.bincount(f.feature, p[f.row, 1], FEATURES)) / f.n - SHRINK * node, (seen_edge - expected_edge) / f.n - SHRINK * edge]
        for i in range(2):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            s[i] = 0.99 * s[i] + 0.01 * g[i] ** 2
        step = [RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8) for a, b in zip(m, s)]
        node, edge = node + step[0], edge + step[1]
    return node, edge


@lru_cache(maxsize=1)
def fitted() -> tuple[np.ndarray, np.ndarray]:
    return fit(list(labelled_pages(PAGES, SEED)))


def texts(sources: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    f = Forest(pages)
    content = marginals(f, *weights)[0][:, 1] >= 0.5
    return [" ".join(text for at, text in p.pieces if content[begin + at]) for p, begin in zip(pages, f.begin)]


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of the pages in ``column``."""
    held = df.sparkSession.sparkContext.broadcast(fitted())
    return append(df, column, [T.StructField(out, T.StringType())], lambda pages: [pa.array(texts(pages.to_pylist(), held.value), pa.string())])
