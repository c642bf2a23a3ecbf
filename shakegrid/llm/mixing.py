"""Mixing sources to target weights (operator 9): Pfair windows, earliest deadline first.

Each source's documents, in the order of a hash, form blocks. In the fluid schedule all sources that still have blocks
are served at once, in proportion to their exact weights, until they run out: with virtual time v, source s has had
min(n_s, w_s v) blocks when sum(min(n_i, w_i v)) slots are gone. Block j may not go before the slot in which the fluid
schedule begins it and must be gone with the slot in which it ends there; of the blocks that may go, the one with the
earliest deadline goes. The fluid schedule keeps all these windows, so earliest deadline first does too: at no slot is a
source one block or more off its share of the fluid schedule, which is its target weight until the first source runs
out, and then its weight among those left. Windows are exact (integers and fractions), for any number of sources.

Targets are a mapping from source to weight, or by default the count of documents to the power EXPONENT. Sources without
a target, or with weight zero, take no slot of the others: they follow behind them, by the default weights. A source
without documents takes no slot. Null is a source like any other; all documents are placed, each once, and repeated rows each.

Rows are ranked within hashed buckets of their source and shifted by counts of the buckets before, so a source that holds
most of the rows is spread over many tasks. The schedule itself is one pass over blocks, not over documents: a single task
reads one row for each source, holds two numbers for each of them, and writes a row for each block as it goes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

BLOCK, EXPONENT = 64, 0.5
BUCKET_ROWS = 20_000
#: Blocks that the schedule hands on at once.
HANDED = 50_000


def fluid(sources: list[tuple[str, int, float]], base: int = 0) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of (source, blocks, weight), slot by slot from ``base`` on; all weights above zero."""
    exact = [Fraction(w) for _, _, w in sources]
    whole = max((w.denominator for w in exact), default=1)  # of floats, all are powers of two
    ends = sorted(((n, int(w * whole), s) for (s, n, _), w in zip(sources, exact)), key=lambda x: (Fraction(x[0], x[1]), x[2]))
    gone = [0, *accumulate(n for n, _, _ in ends)]
    rest = [*accumulate(w for _, w, _ in reversed(ends))][::-1] + [0]
    at = [0] * len(ends)

    def scaled(i: int, j: int) -> int:
        """Slots, times the weight of source i, until the fluid schedule has served j blocks of it; j never falls."""
        w = ends[i][1]
        if at[i] < len(ends) and ends[at[i]][0] * w <= j * ends[at[i]][1]:
            at[i] += bisect_left(range(at[i], len(ends)), True, key=lambda k: ends[k][0] * w > j * ends[k][1])
        return gone[at[i]] * w + j * rest[at[i]]

    later = [(0, i, 0) for i in range(len(ends))]  # release, source, number of its block
    heapq.heapify(later)
    ready: list[tuple[int, int, int, int]] = []
    for t in range(gone[-1]):
        while later and later[0][0] <= t:
            release, i, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-scaled(i, j + 1) // ends[i][1]), release, i, j))
        _, _, i, j = heapq.heappop(ready)
        yield ends[i][2], j, base + t
        if j + 1 < ends[i][0]:
            heapq.heappush(later, (scaled(i, j + 1) // ends[i][1], i, j + 1))


def schedule(sources: list[tuple[str, int, float]]) -> Iterator[tuple[str, int, int]]:
    """``fluid`` of the sources with a weight, then of those without one by their default weights."""
    first = [x for x in sources if x[2] > 0]
    yield from fluid(first)
    yield from fluid([(s, n, n**EXPONENT) for s, n, w in sources if not w > 0], sum(n for _, n, _ in first))


def schedule_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources = sorted((r["__name"], r["blocks"], r["weight"]) for batch in batches for r in batch.to_pylist())
    names, blocks, slots = [], [], []
    for s, j, t in schedule(sources):
        names.append(s), blocks.append(j), slots.append(t)
        if len(names) == HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], names=["__name", "mix_block", "mix_slot"])
            names, blocks, slots = [], [], []
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(slots, pa.int64())], names=["__name", "mix_block", "mix_slot"])


def shares(weights: dict[int, float]) -> dict[int, int]:
    """Rounded plan, not used by ``mix``: whole parts of a period of ten slots a source, at least 100 in all, one at least."""
    period, total = max(100, 10 * len(weights)), sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(share: dict[int, int]) -> dict[int, list[int]]:
    """The slots of each source in one period: earliest deadline first among the released blocks."""
    period = sum(share.values())
    slots: dict[int, list[int]] = {s: [] for s in share}
    later = [(0, s, 1) for s in share]  # release, source, number of its block
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        while later and later[0][0] <= t:
            _, s, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-j * period // share[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j < share[s]:
            heapq.heappush(later, (j * period // share[s], s, j + 1))
    return slots


def plan(blocks: dict[int, int], weights: dict[int, float]) -> list[tuple]:
    """Rounded plan, not used by ``mix``: where the blocks of each source go in each phase; a phase ends when a source runs out."""
    left, done, base, rows = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        share = shares({s: weights[s] for s in left})
        period, slots = sum(share.values()), one_period(share)

        def slot(s: int, j: int) -> int:
            return j // share[s] * period + slots[s][j % share[s]]

        end = min(slot(s, n - 1) for s, n in left.items()) + 1
        for s in list(left):
            n = end // period * share[s] + bisect_left(slots[s], end % period)
            if n:
                rows.append((s, done[s], done[s] + n - 1, base, period, share[s], slots[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += end
    return rows


def mix(df: DataFrame, targets: dict[str | None, float] | None = None, source: str = "source", keys: tuple[str, ...] = ("doc_id", "text"), block: int = BLOCK) -> DataFrame:
    """``df`` with mix_block (of its source), mix_slot and mix_position; columns of these names are replaced.

    Positions order the rows and are unique; the last block of a source may leave some of its positions free.
    """
    spark = df.sparkSession
    df = df.drop("mix_block", "mix_slot", "mix_position")
    name = F.when(df[source].isNull(), "-").otherwise(F.concat(F.lit("+"), df[source].cast("string")))
    row = F.xxhash64(*(df[k] for k in keys), df[source])
    rows = df.select("*", row.alias("__row"), name.alias("__name"))
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.pmod("__row", F.lit(buckets)))
    counts = cut(rows.groupBy("__name", "__bucket").agg(F.count("*").alias("__n")))
    sizes = counts.groupBy("__name").agg(F.sum("__n").alias("n"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(EXPONENT)))
    else:
        given = [("-" if s is None else f"+{s}", float(w)) for s, w in targets.items()]
        sizes = sizes.join(spark.createDataFrame(given, "__name string, weight double"), "__name", "left")
    sizes = sizes.select("__name", F.ceil(F.col("n") / block).cast("long").alias("blocks"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    slots = cut(sizes.repartition(1).mapInArrow(schedule_batches, "__name string, mix_block long, mix_slot long"))
    before = Window.partitionBy("__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    touched = F.sequence(F.floor(F.col("__shift") / block), F.floor((F.col("__shift") + F.col("__n") - 1) / block))
    of = shift.select("__name", "__bucket", "__shift", F.explode(touched).alias("mix_block")).join(slots, ["__name", "mix_block"])
    # the slots of a bucket's blocks come to its rows as one list, so that the texts do not move again
    of = of.groupBy("__name", "__bucket", "__shift").agg(F.sort_array(F.collect_list(F.struct("mix_block", "mix_slot"))).alias("__slots"))
    order = Window.partitionBy("__name", "__bucket").orderBy("__row", *(F.col(k) for k in keys))
    ranked = rows.withColumn("__rank", F.row_number().over(order)).join(of, ["__name", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__shift")).withColumn("mix_block", F.floor(F.col("__rank") / block))
    slot = F.get("__slots", (F.col("mix_block") - F.floor(F.col("__shift") / block)).cast("int"))["mix_slot"]
    placed = ranked.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * block + F.col("__rank") % block)
    return placed.select(*df.columns, "mix_block", "mix_slot", "mix_position")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` in the order of their positions: ranges over partitions, sorted within, positions left out."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position")
    return ordered.drop("mix_block", "mix_slot", "mix_position")
