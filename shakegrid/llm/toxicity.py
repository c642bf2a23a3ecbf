"""Toxicity (operator 10): a bidirectional gated recurrent network over words and their characters.

A word enters as evidence of the word and of its character 4-grams (log odds of the training documents that hold it,
toxic against clean; in training without the document at hand) and as learned vectors of the word and of its 4-grams,
all by hash. A word longer than LONG bytes enters as pieces of that length that overlap by SHARED, each as a word of its own,
so texts without white space are read to their end. Windows of 32 words overlap by 8 and cover the whole text; all are scored, attention pools each, and the
largest logit of a text, calibrated, is its score; a text without words scores zero. Only the text is an input.

All labelled documents teach. Tasks count the documents of both labels by hashed word and 4-gram, whatever their number in
WORDS + GRAMS slots; pick the window of each document in which its words speak loudest; and train on shards of about
SHARD windows, dealt by the hash of the id. After each of EPOCHS passes the states of the shards, summed in each task, are averaged by Spark.
The curve of calibration is fitted on counts of the largest logits of all labelled documents, in steps of 1/64. Only
those counts, the slots and the averaged state come to the driver, none of which grows with the input. Texts are scored in
the tasks that read them, nothing is shuffled. Null texts are empty. Repeated rows are scored each, and teach once for
each label; without labels of both kinds, all scores are the share of toxic labels (0 if there are none). Further columns pass through; one named like the output is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import pin
from . import gru
from .common import append, slices, words
from .sampling import labelled

WINDOW, STRIDE, HIDDEN, TABLE, SIZE = 32, 24, 8, 4096, 4
#: Bytes of the longest word that enters whole, and those that two pieces of a longer one share.
LONG, SHARED = 64, 16
#: Slots of the document counts of words and of 4-grams.
WORDS, GRAMS = 1 << 19, 1 << 18
#: Windows of a shard, and shards that a task of a large input trains, one after the other; their states leave it as one sum.
SHARD, TOGETHER = 4096, 8
EPOCHS, BATCH, SEED = 10, 128, 7
#: Words whose inputs a worker keeps, windows that it gathers, and those that it runs at once.
CACHE, HELD, AT_ONCE = 300_000, 4096, 1024


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, long ones in pieces; all 4-grams inside a word are inside a piece."""
    ws = words(text)
    if max(map(len, ws), default=0) <= LONG:
        return ws
    return [*chain.from_iterable([w] if len(w) <= LONG else (w[i : i + LONG] for i in range(0, len(w) - SHARED, LONG - SHARED)) for w in ws)]


def grams(word: bytes) -> list[bytes]:
    w = b"^" + word + b"$"
    return [w[i : i + 4] for i in range(max(1, len(w) - 3))]


def starts_of(n: int) -> range:
    """First words of the windows over ``n`` words."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def odds(pos, neg, n_pos: int, n_neg: int):
    """Smoothed log odds, drawn to zero where few documents speak."""
    pos, neg = np.maximum(pos, 0), np.maximum(neg, 0)
    raw = np.log((pos + 0.1) / (n_pos + 0.2)) - np.log((neg + 0.1) / (n_neg + 0.2))
    return raw * (pos + neg) / (pos + neg + 1.0)


def crc_parts() -> np.ndarray:
    """What a byte adds to the crc32 of four, by its place: the exclusive or of the four entries is the crc32."""
    none = zlib.crc32(bytes(4))
    out = np.array([[zlib.crc32(bytes(i) + bytes([b]) + bytes(3 - i)) ^ none for b in range(256)] for i in range(4)], np.uint32)
    out[0] ^= none
    return out


CRC = crc_parts()


def spelled(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of the 4-grams of all words, one word behind the other, where each begins, and how many it has."""
    length = np.fromiter(map(len, ws), np.int64, len(ws))
    size = np.maximum(length - 1, 1)
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"^" + b"$^".join(ws) + b"$\0\0\0", np.uint8)
    at = np.repeat(np.cumsum(length + 2) - (length + 2) - first, size) + np.arange(size.sum())
    flat = (CRC[0][raw[at]] ^ CRC[1][raw[at + 1]] ^ CRC[2][raw[at + 2]] ^ CRC[3][raw[at + 3]]).astype(np.int64)
    for i in np.flatnonzero(length < 2):
        flat[first[i]] = zlib.crc32(grams(ws[i])[0])
    return flat, first, size


def tally(texts: list[list[bytes]], y: list[int]) -> np.ndarray:
    """Documents by slot, of words and then of 4-grams: toxic ones, clean ones."""
    seen, out = (Counter(), Counter()), np.zeros((2, WORDS + GRAMS))
    for ws, label in zip(texts, y):
        seen[0 if label else 1].update(set(ws))
    for side, c in enumerate(seen):
        ws, n = list(c), np.fromiter(c.values(), float, len(c))
        flat, _, size = spelled(ws)
        np.add.at(out[side], np.fromiter(map(zlib.crc32, ws), np.int64, len(ws)) % WORDS, n)
        np.add.at(out[side], WORDS + flat % GRAMS, np.repeat(n, size))
    return out


class Model:
    """What workers need; ``word`` and ``gram`` hold the log odds of the slots that several training documents share."""

    def __init__(self, rate: float = 0.0):
        self.rate, self.params, self.word, self.gram, self.scale = rate, None, None, None, (1.0, 0.0)
        self._rows: dict[bytes, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._rows = {}

    def inform(self, counts: np.ndarray, n: tuple[int, int], without: int | None = None) -> Model:
        """Evidence from ``tally`` over ``n`` documents; ``without`` is the label of the document at hand, which is left out."""
        if without is None:
            odds_ = np.where(counts.sum(axis=0) > 1, odds(*counts, *n), 0.0)
        else:
            odds_ = odds(counts[0] - (without == 1), counts[1] - (without == 0), *n)
        self.word, self.gram = odds_[:WORDS].astype(np.float32), odds_[WORDS:].astype(np.float32)
        return self

    def evidence(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, strongest 4-gram, mean 4-gram) of each word; the hashes of the words; and what ``spelled`` says."""
        flat, first, size = spelled(ws)
        lo, hashes = self.gram[flat % GRAMS], np.fromiter(map(zlib.crc32, ws), np.int64, len(ws))
        return np.c_[self.word[hashes % WORDS], np.maximum.reduceat(lo, first), np.add.reduceat(lo, first) / size], hashes, flat, first, size

    def inputs(self, ws: list[bytes]) -> np.ndarray:
        p = self.params
        x = np.empty((len(ws), 3 + 2 * SIZE), np.float32)
        x[:, :3], hashes, flat, first, size = self.evidence(ws)
        x[:, 3 : 3 + SIZE] = p["word"][hashes % TABLE]
        x[:, 3 + SIZE :] = np.add.reduceat(p["gram"][flat % TABLE], first, axis=0) / size[:, None]
        return x

    def _ids(self, ws: list[bytes]) -> list[int]:
        """Rows of the words' projected inputs; row 0 is no word."""
        rows, p = self._rows, self.params
        if not rows or len(rows) > CACHE:
            rows.clear()
            rows[b""] = 0
            self._f = np.zeros((1024, 3 * HIDDEN), np.float32)
            self._b = np.zeros((1024, 3 * HIDDEN), np.float32)
        new = [w for w in dict.fromkeys(ws) if w not in rows]
        if new:
            at = len(rows)
            rows.update((w, at + i) for i, w in enumerate(new))
            if len(rows) > len(self._f):
                grown = max(len(rows), 2 * len(self._f))
                self._f, self._b = (np.resize(a, (grown, a.shape[1])) for a in (self._f, self._b))
            x = self.inputs(new)
            self._f[at : at + len(new)], self._b[at : at + len(new)] = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        return [rows[w] for w in ws]

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Largest logit over the windows of each text."""
        best, filled, part, owner, owners = np.full(len(texts), -np.inf), [], [], [], []
        for k, ws in enumerate(texts):
            for at in range(0, max(1, len(ws)), STRIDE << 12):  # a very long text in parts that overlap like its windows
                piece = ws[at : at + (STRIDE << 12) + WINDOW - STRIDE]
                ids = np.array(self._ids(piece), dtype=np.int32)
                n = len(piece)
                for s in starts_of(n) if at + n == len(ws) else range(0, STRIDE << 12, STRIDE):
                    (filled if s + WINDOW <= n else part).append(ids[s : s + WINDOW])
                    (owner if s + WINDOW <= n else owners).append(k)
                if len(filled) >= HELD or len(self._rows) > CACHE:
                    self._flush(filled, owner, part, owners, best)
                if at + n == len(ws):
                    break
        self._flush(filled, owner, part, owners, best)
        return best

    def _flush(self, filled, owner, part, owners, best) -> None:
        if filled:
            np.maximum.at(best, owner, self._run(np.array(filled).T, None))
        if part:
            ids, mask = np.zeros((WINDOW, len(part)), np.int32), np.zeros((WINDOW, len(part)), np.float32)
            for j, x in enumerate(part):
                ids[: len(x), j], mask[: len(x), j] = x, 1
            np.maximum.at(best, owners, self._run(ids, mask))
        for x in (filled, owner, part, owners):
            x.clear()

    def _run(self, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        out = [
            gru.forward(self.params, self._f[ids[:, i : i + AT_ONCE]], self._b[ids[:, i : i + AT_ONCE]], None if mask is None else mask[:, i : i + AT_ONCE])
            for i in range(0, ids.shape[1], AT_ONCE)
        ]
        return np.concatenate(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.params is None:
            return np.full(len(texts), self.rate)
        (a, b), ws = self.scale, [tokens(t) for t in texts]
        return np.where([bool(w) for w in ws], gru.sigmoid(a * self.logits(ws).astype(np.float64) + b), 0.0)


def strongest(models: tuple[Model, Model], texts: list[list[bytes]], y: list[int]) -> list[list[bytes]]:
    """The window of each text in which a word and its strongest 4-gram speak loudest, by the model of its label."""
    out: list[list[bytes]] = [[] for _ in texts]
    for label in (0, 1):
        own = [i for i, v in enumerate(y) if v == label and texts[i]]
        ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts[i] for i in own)))}
        if not ids:
            continue
        loud = models[label].evidence(list(ids))[0][:, :2].sum(axis=1)
        for i in own:
            heard = loud[[ids[w] for w in texts[i]]]
            at = max(starts_of(len(heard)), key=lambda s: heard[s : s + WINDOW].max())
            out[i] = texts[i][at : at + WINDOW]
    return out


class Examples:
    """Windows and labels that one task trains on."""

    def __init__(self, models: tuple[Model, Model], windows: list[list[bytes]], y: list[int]):
        vocabulary = {w: i for i, w in enumerate(sorted({b"", *chain.from_iterable(windows)}))}
        self.y = np.array(y, float)
        self.windows = np.array([[vocabulary[x] for x in ws] + [-1] * (WINDOW - len(ws)) for ws in windows], np.int32).reshape(-1, WINDOW)
        (clean, hashes, flat, first, size), (toxic, *_) = (m.evidence(list(vocabulary)) for m in models)
        self.left_out, self.first, self.size = (clean, toxic), first.astype(np.int32), size.astype(np.int32)
        # as small as they go, for they are written
        self.slots, self.flat = ((x % TABLE).astype(np.int16) for x in (hashes, flat))

    def step(self, state: gru.Adam, both: dict[str, np.ndarray], rows: np.ndarray) -> None:
        w = self.windows[rows].T
        mask = (w >= 0).astype(float)
        w, label = np.maximum(w, 0), self.y[rows]
        ev = np.where(label[None, :, None] > 0, self.left_out[1][w], self.left_out[0][w])
        used, back = np.unique(w, return_inverse=True)
        size = self.size[used]
        begin = np.cumsum(size) - size
        slots = self.flat[np.repeat(self.first[used] - begin, size) + np.arange(size.sum())]
        mean = np.add.reduceat(both["gram"][slots], begin, axis=0) / size[:, None]
        x = np.concatenate([ev, both["word"][self.slots[w]], mean[back.reshape(w.shape)]], axis=2) * mask[:, :, None]
        p = {k: v for k, v in both.items() if k not in ("word", "gram")}
        _, g, dx = gru.gradients(p, x, mask, label, np.ones(len(rows)))
        dx = dx * mask[:, :, None]
        g_word, g_gram, by_word = np.zeros_like(both["word"]), np.zeros_like(both["gram"]), np.zeros((len(used), SIZE))
        np.add.at(g_word, self.slots[w], dx[:, :, 3 : 3 + SIZE])
        np.add.at(by_word, back.reshape(w.shape), dx[:, :, 3 + SIZE :])
        np.add.at(g_gram, slots, np.repeat(by_word / size[:, None], size, axis=0))
        state.step(both, {**g, "word": g_word, "gram": g_gram})

    def learn(self, state: State, epoch: int) -> State:
        """The state after one pass over the windows, in an order that follows from ``epoch``."""
        both, adam = state.open()
        order = np.random.default_rng((SEED, epoch)).permutation(len(self.windows))
        for i in range(0, len(order), BATCH):
            self.step(adam, both, order[i : i + BATCH])
        return State.of(both, adam)


class State:
    """Parameters and the moments of their steps as one vector, so that states can be averaged."""

    def __init__(self, vector: np.ndarray, shapes: dict[str, tuple]):
        self.vector, self.shapes = vector, shapes

    @classmethod
    def first(cls) -> State:
        rng = np.random.default_rng(SEED)
        p = gru.initial(3 + 2 * SIZE, HIDDEN, rng)
        return cls.of({**p, **{k: rng.normal(0, 0.1, (TABLE, SIZE)) for k in ("word", "gram")}}, gru.Adam())

    @classmethod
    def of(cls, p: dict[str, np.ndarray], adam: gru.Adam) -> State:
        parts = [[x.get(k, np.zeros_like(v)).ravel() for k, v in p.items()] for x in (p, adam.m, adam.s)]
        return cls(np.concatenate([[float(adam.t)], *chain.from_iterable(parts)]), {k: v.shape for k, v in p.items()})

    def open(self) -> tuple[dict[str, np.ndarray], gru.Adam]:
        adam, at, parts = gru.Adam(), 1, []
        adam.t = int(round(self.vector[0]))
        for _ in range(3):
            part = {}
            for k, shape in self.shapes.items():
                size = int(np.prod(shape))
                part[k] = self.vector[at : at + size].reshape(shape).copy()
                at += size
            parts.append(part)
        adam.m, adam.s = parts[1:]
        return parts[0], adam

    def params(self) -> dict[str, np.ndarray]:
        return {k: v.astype(np.float32) for k, v in self.open()[0].items()}


def informed(rate: float, counts: np.ndarray, n: tuple[int, int]) -> tuple[Model, tuple[Model, Model]]:
    """The model with its evidence, and for each label the one without a document of that label."""
    return Model(rate).inform(counts, n), tuple(Model(rate).inform(counts, n, label) for label in (0, 1))


def fit(toxic: list[str], clean: list[str], n_toxic: int, n_clean: int) -> Model:
    """``train`` on texts at hand, as one shard."""
    rate = n_toxic / max(1, n_toxic + n_clean)
    if not toxic or not clean:
        return Model(rate)
    texts, y = [tokens(t) for t in toxic + clean], [1] * len(toxic) + [0] * len(clean)
    model, models = informed(rate, tally(texts, y), (len(toxic), len(clean)))
    examples, state = Examples(models, strongest(models, texts, y), y), State.first()
    for epoch in range(EPOCHS):
        state = examples.learn(state, epoch)
    model.params = state.params()
    top = np.empty(len(y))
    for label, m in enumerate(models):
        m.params, own = model.params, np.array(y) == label
        top[own] = m.logits([t for t, o in zip(texts, own) if o])
    model.scale = calibrated(top.astype(float), np.array(y, float), np.ones(len(y)))
    return model


def calibrated(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the largest logits, by a few damped Newton steps."""
    a, b = 1.0, 0.0
    x = np.c_[logit, np.ones(len(logit))]
    for _ in range(50):
        q = gru.sigmoid(x @ [a, b])
        grad = x.T @ (weight * (q - y)) + 1e-2 * np.array([a - 1.0, 0.0])
        hess = (x.T * (weight * np.maximum(q * (1 - q), 1e-6))) @ x + np.diag([1e-2, 1e-6])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """A model of labels.toxic from all documents that ``where`` admits."""
    counted = labels if where is None else labels.where(where)
    toxic, clean = counted.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    rate = toxic / max(1, toxic + clean)
    rows = labelled(docs, labels.where("toxic in (0, 1)"), "toxic", where).select(F.xxhash64("doc_id").alias("key"), F.col("toxic").cast("int").alias("y"), "text")
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            yield part.column("key").to_pylist(), [tokens(t) for t in part.column("text").to_pylist()], part.column("y").to_pylist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, WORDS + GRAMS)), [0, 0]
        for _, texts, y in pieces(batches):
            total += tally(texts, y)
            n = [n[0] + sum(y), n[1] + len(y) - sum(y)]
        at = np.flatnonzero(total.sum(axis=0))
        # slot -1 holds the documents themselves
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), *(pa.array(np.r_[n[k], total[k, at]].astype(np.int64)) for k in (0, 1))], names=["slot", "pos", "neg"])

    got = rows.mapInArrow(count, "slot long, pos long, neg long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    slot, sums = got.column("slot").to_numpy(), np.array([got.column(c).to_numpy() for c in ("pos", "neg")], float)
    n = tuple(int(x) for x in sums[:, slot < 0].sum(axis=1))
    if not all(n):
        return Model(rate)
    counts = np.zeros((2, WORDS + GRAMS))
    counts[:, slot[slot >= 0]] = sums[:, slot >= 0]
    model, models = informed(rate, counts, n)
    held = spark.sparkContext.broadcast(models)
    shards = max(1, sum(n) // SHARD)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, y in pieces(batches):
            windows = pa.array(strongest(held.value, texts, y), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(y, pa.int32()), windows], names=["key", "y", "words"])

    windows = rows.mapInArrow(pick, "key long, y int, words array<binary>").withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    tasks = min(shards, max(2 * spark.sparkContext.defaultParallelism, -(-shards // TOGETHER)))

    def ready(part: pa.Table) -> pa.Table:
        own = sorted(zip(*(part.column(c).to_pylist() for c in ("key", "y", "words"))))
        whole = pickle.dumps(Examples(held.value, [x[2] for x in own], [x[1] for x in own]))
        return pa.table({"n": pa.array([len(own)], pa.int64()), "examples": pa.array([whole], pa.binary())})

    examples = pin(windows.repartition(tasks, "shard").groupBy("shard").applyInArrow(ready, "n long, examples binary"))
    state = State.first()
    for epoch in range(EPOCHS):
        now = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            after = None
            for batch in batches:
                for k, shard in zip(batch.column("n").to_pylist(), batch.column("examples")):
                    own = pickle.loads(shard.as_buffer()).learn(now.value, epoch).vector * k
                    after = own if after is None else after + own
            if after is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(after))), pa.array(after)], names=["i", "v"])

        mean = examples.mapInArrow(learn, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
        state = State(mean.column("v").to_numpy() / sum(n), state.shapes)
    model.params = state.params()
    for m in models:
        m.params = model.params
    final = spark.sparkContext.broadcast(models)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, y in pieces(batches):
            for label, m in enumerate(final.value):
                top = m.logits([t for t, v in zip(texts, y) if v == label]).astype(float)
                step, k = np.unique(np.rint(np.clip(top, -1000, 1000) * 64).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), label, np.int32)), pa.array(step), pa.array(k)], names=["y", "step", "k"])

    tops = rows.mapInArrow(largest, "y int, step long, k long").groupBy("y", "step").agg(F.sum("k").alias("k")).toArrow().sort_by([("y", "ascending"), ("step", "ascending")])
    y, step, k = (tops.column(c).to_numpy().astype(float) for c in ("y", "step", "k"))
    model.scale = calibrated(step / 64, y, k)
    return model


def score(df: DataFrame, model: Model, column: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of ``column``, 0 to 1."""
    held = df.sparkSession.sparkContext.broadcast(model)
    return append(df, column, [T.StructField(out, T.DoubleType())], lambda texts: [pa.array(held.value.scores(texts.to_pylist()), pa.float64())])
