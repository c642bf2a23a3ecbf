"""Quality classifier (operator 2): an interpolated modified Kneser-Ney model of trusted text.

One model for each language and one of all, over the characters of every trusted text: white space is one space, a word
that repeats the one before it is one mark, characters met twice at most are one class. Grams of the longest order are
counted in the tasks and summed by key; shorter orders count distinct left neighbours. Discounts follow from counts of
counts, and the probabilities of an order come from a join, dealt by gram, with those of the order below. A model of at
most MODEL_ROWS rows is sent to the tasks, where each text looks its grams up in the shard of its language and nothing of
the texts is shuffled. A larger one stays a table: texts are dealt to blocks, the distinct grams of the blocks are
joined with it order by order, and their values go back to the blocks; the perplexities are the same.

Perplexity is that of a character, drawn to the model's own mean as if PRIOR more characters had been seen, so that very
short texts are not judged by chance. A document is kept while its perplexity is at most the language's threshold: a
high quantile, over all trusted documents, times a margin. Null and empty texts have the mean perplexity and are kept.
A language without trusted text, or none, is judged by the model and threshold of all languages together; without any
trusted text, all rows are kept with a null perplexity. Repeated rows are judged each; further columns pass through,
ones named like the outputs are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut
from .common import append, slices
from .sampling import labelled

ORDER, BITS, PRIOR = 4, 15, 40
#: Classes of a language; ORDER of them, BITS each, make a gram.
CLASSES = (1 << BITS) - 8
#: Bytes of text that a task scores at once.
SLICE = 1 << 20
REPEAT, BEGIN, RARE = 1, 2, 3
QUANTILE, MARGIN = 0.999, 1.05
#: Rows of a model that may be sent to tasks; a larger one is joined.
MODEL_ROWS = 6_000_000
#: Code points of the texts of a block that meet a joined model.
BLOCK_CHARS = 24_000_000


def plain(text: str | None) -> str:
    ws = (text or "").split()
    marked = " ".join(["\x01" if a == b else b for a, b in zip(chain((None,), ws), ws)])
    return marked.replace(" \x01", "\x01")


class Alphabet:
    """Classes of code points: the frequent ones have their own, from 4 on."""

    def __init__(self, chars: list[str]):
        self.size = 4 + len(chars)
        # The last place stands for all code points beyond.
        self.map = np.full(max(map(ord, chars), default=1) + 2, RARE, np.uint16)
        self.map[1] = REPEAT
        for i, c in enumerate(chars):
            self.map[ord(c)] = 4 + i

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the ORDER-grams that end at each character, first class in the highest bits; characters a text."""
        gap = np.full(ORDER - 1, BEGIN, np.uint16)
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        flat = np.concatenate([x for p in points for x in (gap, self.map[np.minimum(p, len(self.map) - 1)])] or [gap])
        sizes = np.array([len(p) for p in points], dtype=np.int64)
        keys = np.zeros(len(flat), np.int64)
        for k in range(ORDER):
            keys[k:] |= flat[: len(flat) - k].astype(np.int64) << (BITS * k)
        own = np.ones(len(flat), bool)
        begin = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        own[(begin[:, None] + np.arange(ORDER - 1)).ravel()] = False
        return keys[own] if len(points) else keys[:0], sizes


def by_model(part: pa.RecordBatch) -> dict[str, list[str]]:
    """Plain texts of ``part`` (lang, text) by the models that learn from them: of their language, if any, and of all."""
    texts = defaultdict(list)
    for lang, text in zip(part.column("lang").to_pylist(), map(plain, part.column("text").to_pylist())):
        for name in {lang or "", ""}:
            texts[name].append(text)
    return texts


def char_counts(rows: DataFrame) -> DataFrame:
    """(lang, point, n): code points of the texts of each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE)):
            for lang, own in by_model(part).items():
                n = np.bincount(np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "point", "n"])

    return rows.mapInArrow(run, "lang string, point long, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))


def gram_counts(rows: DataFrame, alphabets: dict[str, Alphabet]) -> DataFrame:
    """(lang, gram, c) of the longest order; gram holds the classes, first in the highest byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE)):
            for lang, own in by_model(part).items():
                grams, n = np.unique(alphabets[lang].codes(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "c"])

    return rows.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def interpolated(counts: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(lang, n, gram, logp, logb): log10 p of each seen gram, and of what its continuations leave to the order below.

    ``logb`` belongs to the gram as a context; null where it is none.
    """
    by_order = {ORDER: counts}
    sizes = F.broadcast(counts.sparkSession.createDataFrame(list(classes.items()), "lang string, classes long"))
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1))
        by_order[n] = by_order[n + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("c"))
    below, tables, contexts = None, [], []
    for n in range(1, ORDER + 1):
        t = by_order[n]
        s = t.groupBy("lang").agg(*(F.greatest(F.count(F.when(F.col("c") == i, 1)), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
        t = t.join(F.broadcast(s.join(sizes, "lang").select("lang", "classes", *d)), "lang").withColumn("context", F.shiftright("gram", BITS))
        cut_off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = Window.partitionBy("lang", "context") if n > 1 else Window.partitionBy("lang")
        t = t.withColumn("d", cut_off).withColumn("total", F.sum("c").over(own)).withColumn("left", F.sum("d").over(own) / F.col("total"))
        own_part = (F.col("c") - F.col("d")) / F.col("total")
        if n == 1:
            t = t.select("lang", "gram", "context", "left", (own_part + F.col("left") / F.col("classes")).alias("p"))
        else:
            lower = below.select("lang", F.col("gram").alias("low"), F.col("p").alias("q"))
            t = t.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(lower, ["lang", "low"])
            t = t.select("lang", "gram", "context", "left", (own_part + F.col("left") * F.col("q")).alias("p"))
        below = t = cut(t)
        tables.append(t.select("lang", F.lit(n).alias("n"), "gram", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
        contexts.append(t.select("lang", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double"), F.log10("left")).distinct())
    out = tables[0]
    for x in [*tables[1:], *contexts]:
        out = out.union(x)
    return out


class Model:
    """Shards by language; "" is the one of all languages. A shard: for each order sorted grams and their values.

    Without ``rows`` the shards are empty: the values of grams come from a table by ``joined``.
    """

    def __init__(self, alphabets: dict[str, Alphabet], rows: pa.Table | None):
        self.alphabets, self.shards, self.mean = alphabets, {}, {}
        if rows is None:
            self.shards = dict.fromkeys(alphabets)
            return
        langs, n, gram = rows.column("lang").to_numpy(zero_copy_only=False), rows.column("n").to_numpy(), rows.column("gram").to_numpy()
        logp, logb = rows.column("logp").to_numpy(), rows.column("logb").to_numpy()
        for lang in np.unique(langs.astype(str)):
            own = langs == lang
            shard = {}
            for k in range(ORDER + 1):
                for kind, value in (("p", logp), ("b", logb)):
                    at = np.flatnonzero(own & (n == k) & ~np.isnan(value))
                    at = at[np.argsort(gram[at], kind="stable")]
                    shard[kind, k] = gram[at], value[at].astype(np.float32)
            self.shards[lang] = shard

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def log10(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log10 p of the last class of each gram: the longest seen order, and the weights of the contexts above it."""
        shard, out = self.shards[lang], np.zeros(len(keys), np.float64)
        open_, part = np.arange(len(keys)), keys
        for n in range(ORDER, 0, -1):
            found, value = look_up(shard["p", n], part)
            out[open_[found]] += value
            open_, part = open_[~found], part[~found]
            if not len(open_):
                return out
            held, weight = look_up(shard["b", n - 1], part >> BITS)
            out[open_[held]] += weight
            part = part & ((1 << BITS * (n - 1)) - 1)
        out[open_] -= np.log10(self.alphabets[lang].size)
        return out

    def keys(self, langs: list[str | None], texts: list[str | None]) -> Iterator[tuple[str, list[int], np.ndarray, np.ndarray]]:
        """For each model in use its language, its rows, the grams of their texts one behind the other, and characters a text."""
        by = defaultdict(list)
        for i, lang in enumerate(langs):
            by[lang if lang in self.shards else ""].append(i)
        for lang, rows in by.items():
            yield lang, rows, *self.alphabets[lang].codes([plain(texts[i]) for i in rows])

    def perplexity(self, langs: list[str | None], texts: list[str | None], log10: Callable[[str, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        out = np.empty(len(texts))
        for lang, rows, keys, sizes in self.keys(langs, texts):
            total = np.concatenate([[0.0], np.cumsum((log10 or self.log10)(lang, keys))])
            ends = np.cumsum(sizes)
            sums = total[ends] - total[ends - sizes]
            out[rows] = 10 ** -((sums + PRIOR * self.mean.get(lang, 0.0)) / (sizes + PRIOR))
        return out


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the sorted table has, and the values of those."""
    grams, values = table
    if not len(grams):
        return np.zeros(len(keys), bool), values
    at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
    found = grams[at] == keys
    return found, values[at[found]]


def joined(keys: DataFrame, table: DataFrame, alphabets: dict[str, Alphabet]) -> DataFrame:
    """``keys`` (lang, gram, distinct) with ``v``, what ``Model.log10`` says of them, by joins with the rows of the model."""
    left = keys.select("*", F.col("gram").alias("_part"), F.lit(0.0).alias("v"))
    out = []
    for n in range(ORDER, 0, -1):
        p = table.where((F.col("n") == n) & F.col("logp").isNotNull()).select("lang", F.col("gram").alias("_part"), F.col("logp").cast("float"))
        b = table.where((F.col("n") == n - 1) & F.col("logb").isNotNull()).select("lang", F.col("gram").alias("_context"), F.col("logb").cast("float"))
        met = cut(left.join(p, ["lang", "_part"], "left").withColumn("_context", F.shiftright("_part", BITS)))
        out.append(met.where("logp is not null").withColumn("v", F.col("v") + F.col("logp")).select(*keys.columns, "v"))
        left = met.where("logp is null").join(b, ["lang", "_context"], "left").withColumns(
            {"v": F.col("v") + F.coalesce("logb", F.lit(0.0)), "_part": F.col("_part").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))})
        left = left.select(*keys.columns, "_part", "v")
    sizes = F.broadcast(keys.sparkSession.createDataFrame([(k, a.size) for k, a in alphabets.items()], "lang string, _size long"))
    out.append(left.join(sizes, "lang").withColumn("v", F.col("v") - F.log10("_size")).select(*keys.columns, "v"))
    return reduce(DataFrame.unionByName, out)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trained on all documents of quality 1; None without any. A model of more than MODEL_ROWS rows has them in ``table``."""
    rows = cut(labelled(docs, labels.where("quality = 1"), "quality", columns=("lang",)).select("lang", "text"))
    by = {r[0]: [] for r in rows.select(F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit(""))))).distinct().collect()}
    # Bounded by the code points of Unicode, for each language.
    for r in char_counts(rows).where("point <> 1 and n > 2").collect():
        by[r.lang].append((-r.n, chr(r.point)))
    if not any(by.values()):
        return None
    alphabets = {lang: Alphabet([c for _, c in sorted(own)[:CLASSES]]) for lang, own in by.items()}
    counts = cut(gram_counts(rows, alphabets))
    table = cut(interpolated(counts, {k: a.size for k, a in alphabets.items()}))
    large = table.count() > MODEL_ROWS
    model = Model(alphabets, None if large else table.toArrow())
    model.table = table if large else None
    # The training texts hold each gram as often as it was counted.
    if large:
        valued = joined(counts, table, alphabets).select("lang", (F.col("c") * F.col("v")).alias("s"), F.col("c").alias("n"))
    else:
        held = counts.sparkSession.sparkContext.broadcast(model)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, grams, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("lang", "gram", "c"))
                for lang in set(langs):
                    own = langs == lang
                    s = float((c[own] * held.value.log10(lang, grams[own])).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s]), pa.array([int(c[own].sum())])], names=["lang", "s", "n"])

        valued = counts.mapInArrow(weigh, "lang string, s double, n long")
    sums = valued.groupBy("lang").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    model.mean = {r.lang: r.s / max(r.n, 1) for r in sums.collect()}
    return model


def perplexities(df: DataFrame, model: Model | None, out: str = "perplexity") -> DataFrame:
    """``df`` (text, lang) with the perplexity of each text."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if model.table is not None:
        return _perplexities_joined(df, model, out)
    held = df.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array, langs: pa.Array) -> list[pa.Array]:
        return [pa.array(held.value.perplexity(langs.to_pylist(), texts.to_pylist()), pa.float64())]

    return append(df, ["text", "lang"], [T.StructField(out, T.DoubleType())], fn, SLICE)


def _perplexities_joined(df: DataFrame, model: Model, out: str) -> DataFrame:
    """The same for a model that is too large to be sent."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)
    blocks = max(1, -(-(df.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.drop(out)
    blocked = df.withColumn("_block", F.pmod(F.xxhash64("text", "lang"), F.lit(blocks)).cast("int"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE)):
            block, langs, texts = (part.column(c).to_pylist() for c in ("_block", "lang", "text"))
            for b in set(block):
                at = [i for i, x in enumerate(block) if x == b]
                for lang, _, keys, _ in held.value.keys([langs[i] for i in at], [texts[i] for i in at]):
                    keys = np.unique(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b, np.int32)), pa.array([lang] * len(keys), pa.string()), pa.array(keys)], names=["_block", "lang", "gram"])

    met = cut(blocked.select("_block", "lang", "text").mapInArrow(grams, "_block int, lang string, gram long").distinct())
    values = met.join(cut(joined(met.select("lang", "gram").distinct(), model.table, model.alphabets)), ["lang", "gram"])

    def add(texts: pa.Table, values: pa.Table) -> pa.Table:
        langs, shard = values.column("lang").to_numpy(zero_copy_only=False), {}
        gram, v = values.column("gram").to_numpy(), values.column("v").to_numpy()
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            own = own[np.argsort(gram[own])]
            shard[lang] = gram[own], v[own]
        log10 = lambda lang, keys: look_up(shard[lang], keys)[1] if len(keys) else np.zeros(0)
        made = []
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "text", SLICE):
                made.append(held.value.perplexity(part.column("lang").to_pylist(), part.column("text").to_pylist(), log10))
        return texts.drop_columns(["_block"]).append_column(out, pa.array(np.concatenate(made) if made else [], pa.float64()))

    schema = T.StructType([*df.schema, T.StructField(out, T.DoubleType())])
    return blocked.repartition(parts, "_block").groupBy("_block").cogroup(values.groupBy("_block")).applyInArrow(add, schema)


def thresholds(scored: DataFrame, labels: DataFrame, model: Model | None, quantile: float = QUANTILE, margin: float = MARGIN) -> dict[str, float]:
    """Largest perplexity to keep, for each language of the model, from all trusted rows of ``scored`` (doc_id, lang, perplexity)."""
    if model is None:
        return {}
    trusted = scored.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    of = F.when(F.col("lang").isin([x for x in model.shards if x]), F.col("lang")).otherwise("")
    rows = trusted.select(F.explode(F.array_distinct(F.array(of, F.lit("")))).alias("lang"), "perplexity").where("perplexity is not null")
    # A bracket well below the quantile leaves few rows in which the exact one is found.
    low = F.percentile_approx("perplexity", F.lit(max(1 - 3 * (1 - quantile), 0.0)), F.lit(20_000))
    by = rows.groupBy("lang").agg(F.count("*").alias("n"), low.alias("low"))
    # A row a language of the model.
    top = rows.join(F.broadcast(by), "lang").where("perplexity >= low")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("perplexity")))
    found = top.withColumn("rank", rank).where(F.col("rank") == F.floor(F.col("n") * (1 - quantile)) + 1).select("lang", "perplexity")
    limits = {r[0]: r[1] * margin for r in found.collect()}
    return limits if "" in limits else {}


def judged(scored: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``scored`` (lang, perplexity, ...) with threshold and kept; without limits all is kept."""
    if not limits:
        return scored.withColumn("threshold", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    by = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    scored = scored.withColumn("threshold", F.coalesce(by[F.coalesce("lang", F.lit(""))], by[F.lit("")]))
    return scored.withColumn("kept", F.col("perplexity") <= F.col("threshold"))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, perplexity), written once; texts are read where they lie."""
    return cut(perplexities(docs.select("doc_id", "lang", "text"), model).select("doc_id", "lang", "perplexity"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with perplexity, threshold and kept.

    Texts are scored once; the scored rows are written, so that the thresholds come from them.
    """
    model = fit(docs, labels)
    scored = cut(perplexities(docs, model))
    return judged(scored, thresholds(scored.select("doc_id", "lang", "perplexity"), labels, model, quantile, margin))
