"""Embedding near-dedup (operator 1): small-world graphs per shard, every shard queried, links verified and united.

Vectors are compared where labels are equal and not null. Equal vectors are one class. The classes of a label are dealt
by hash into shards of about SHARD; a task builds the graph of one shard and writes it to the shared folder. The
classes also form blocks of queries, and each block meets each shard of its label in a task that holds one of each. The
beam of a query is widened while all of it are links. A query that fills a beam of WIDEST is compared with its whole
shard. Of the other queries of a block, those that the graph alone answered, every AUDIT-th and at least AUDITED are
held against the whole shard, and the beam of the block is widened until the share RECALL of those with links has all of them. Cosines near the threshold are verified in double precision. A task hands on counts of links and, of the links
themselves, one for each point that it joined to others, so groups of near copies are never written out as pairs.

Vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label or id, link with
nothing; vectors of different lengths do not link. Repeated rows (same id, label and vector) are one vector and have a
row of the result each. Other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .components import components
from .hnsw import Graph

SHARD, BLOCK = 16_384, 4_096
BEAM, WIDEST, AUDIT, AUDITED, RECALL = 64, 512, 16, 64, 0.995
#: Queries that walk a graph at once.
TOGETHER = 256
LINKS = "kind string, a long, b long"


def scaled(vectors: pd.Series) -> np.ndarray:
    """Rows of doubles, each times the power of two that brings its largest component into [0.5, 1): cosines stay, squares neither vanish nor overflow."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return (x / norm[:, None]).astype(np.float32), norm


class Union:
    """Roots of points 0..n-1; the smallest of what is joined is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            go = hi > lo
            if not go.any():
                return
            np.minimum.at(self.root, hi[go], lo[go])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def near(graph: Graph, q: np.ndarray, limit: float, same: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, point) arrays, batch by batch, of all that are at least about ``limit`` similar, as the audit allows.

    ``same`` has the point that is the query itself, -1 if none; it does not count in the audit.
    """
    n = len(graph.x)
    beam = min(BEAM, n)
    while True:
        out, walked = [], np.ones(len(q), bool)
        for at in range(0, len(q), TOGETHER):
            part = q[at : at + TOGETHER]
            rows, hits, width = np.arange(len(part)), [], beam
            while len(rows):
                if width > WIDEST or width >= n:
                    walked[rows + at] = False
                    r, p = np.nonzero(part[rows] @ graph.x.T >= limit)
                    hits.append((rows[r], p))
                    break
                ids, sims = graph.beam(part[rows], width)
                linked = sims >= limit
                full = linked.all(axis=1)
                r, c = np.nonzero(linked & ~full[:, None])
                hits.append((rows[r], ids[r, c]))
                rows, width = rows[full], width * 2
            a, b = (np.concatenate([h[i] for h in hits]) for i in range(2))
            out.append((a + at, b))
        if beam > WIDEST or beam >= n or whole(graph, q, limit, same, np.flatnonzero(walked), out) >= RECALL:
            return out
        beam *= 2


def whole(graph: Graph, q: np.ndarray, limit: float, same: np.ndarray | None, walked: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Share of the audited among ``walked`` queries, of those that have links, whose links are all in ``out``."""
    audited = walked[:: max(1, min(AUDIT, len(walked) // AUDITED))]
    place = np.full(len(q), -1)
    place[audited] = np.arange(len(audited))
    true = q[audited] @ graph.x.T >= limit + 5e-6  # products in another order differ by less than that
    if same is not None:
        own = np.flatnonzero(same[audited] >= 0)
        true[own, same[audited[own]]] = False
    missed = true.copy()
    for a, b in out:
        of = place[a] >= 0
        missed[place[a[of]], b[of]] = False
    having = true.any(axis=1).sum()
    return 1.0 if not having else 1 - missed.any(axis=1).sum() / having


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    raw = scaled(pdf["vector"])
    x, norm = unit(raw)
    blob = pickle.dumps((Graph(x), norm, raw, pdf["rep"].to_numpy(), pdf["size"].to_numpy()), protocol=5)
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [blob]})


def query(threshold: float):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"kind": pd.Series(dtype=str), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        graph, norm, raw, reps, sizes = pickle.loads(index["graph"].iloc[0])
        own, own_raw = queries["rep"].to_numpy(), scaled(queries["vector"])
        q, own_norm = unit(own_raw)
        n = len(reps)
        count, union = np.zeros(len(own), np.int64), Union(n + len(own))
        place = {r: i for i, r in enumerate(reps)}
        same = np.array([place.get(r, -1) for r in own])
        union.join(np.flatnonzero(same >= 0) + n, same[same >= 0])
        for a, b in near(graph, q, threshold - 1e-5, same):
            close = np.abs(np.einsum("nk,nk->n", q[a], graph.x[b]) - threshold) < 2e-5
            if close.any():
                i, j = a[close], b[close]
                cosine = np.einsum("nk,nk->n", own_raw[i], raw[j]) / (own_norm[i] * norm[j])
                close[close] = cosine < threshold
            ok = ~close & (same[a] != b)
            a, b = a[ok], b[ok]
            count += np.bincount(a, sizes[b], len(own)).astype(np.int64)
            union.join(a + n, b)
        names = np.r_[reps, own]
        root = union.root
        joined = np.flatnonzero((root != np.arange(len(root))) & (names != names[root]))
        return pd.DataFrame({
            "kind": ["n"] * len(own) + ["l"] * len(joined), "a": np.r_[own, names[joined]].astype(np.int64), "b": np.r_[count, names[root[joined]]].astype(np.int64),
        })

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept."""
    rows = df.select(df[id_column].cast("long").alias("id"), df[vector].cast("array<double>").alias("vector"), df[label].cast("string").alias("label"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & ~bad & F.exists("vector", lambda v: v != 0)
    rows = cut(rows.withColumn("ok", F.coalesce(valid, F.lit(False))))
    good = rows.where("ok").distinct()
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("size"))
    of = good.select("id", "label", "vector").join(classes.select("label", "vector", "rep", "size"), ["label", "vector"])
    of = cut(of.select("id", "label", "vector", "rep", "size"))
    reps = of.where("id = rep").select("label", F.size("vector").alias("dim"), "rep", "size", "vector").distinct()
    total = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    hashed = lambda seed, most: F.pmod(F.xxhash64("rep", F.lit(seed)), F.ceil(F.col("n") / most)).cast("int")
    reps = cut(reps.join(total, ["label", "dim"]).withColumn("shard", hashed(1, SHARD)).withColumn("block", hashed(2, BLOCK)))
    parts = ["label", "dim", "shard"]
    graphs = cut(reps.groupBy(*parts).applyInPandas(build, "label string, dim int, shard int, graph binary"))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))
    index = graphs.join(total, ["label", "dim"]).select(*parts, "graph", every(BLOCK).alias("block"))
    queries = reps.select("label", "dim", "rep", "vector", "block", every(SHARD).alias("shard"))
    met = cut(index.groupBy(*parts, "block").cogroup(queries.groupBy(*parts, "block")).applyInPandas(query(threshold), LINKS))
    others = met.where("kind = 'n'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    roots = components(met.where("kind = 'l'").select("a", "b")).select(F.col("node").alias("rep"), "root")
    of_class = of.select("rep", "size").distinct().join(others, "rep", "left").join(roots, "rep", "left")
    of_class = of_class.select("rep", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = of.join(of_class, "rep").select("id", "label", "vector", "n_links", "component_id")
    joined = rows.join(linked, ["id", "label", "vector"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return joined.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
