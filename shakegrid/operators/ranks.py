"""Exact ranks and order statistics without a one-task sort or a one-task group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.measure import col
from ..session import cut, small

#: Bins (a power of two) into which quantiles cut a group, and the rows of a bin up to which its values are counted and sorted.
LEVELS = 64
WIDE = 1 << 20


def ranked(df: DataFrame, order: Sequence, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row inside its ``keys`` group, sorted by ``order``.

    Rows are range-partitioned on (keys, order), so a hot group spreads over many tasks. Each
    row's place in its partition plus the sizes of the group's earlier partitions is its rank.
    Only one row per (group, partition) takes part in the window that adds those sizes up.
    """
    keys = list(keys)
    by = [F.col(k) for k in keys] + [col(o) for o in order]
    placed = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1)
        .select(*keys, "_part", "_shift")
    )
    return (
        placed.join(shift, [*keys, "_part"])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_place", "_part", "_shift")
    )


def row_numbers(df: DataFrame, order: Sequence, name: str = "row_no") -> DataFrame:
    """1-based catalogue row number."""
    return ranked(df, order, name=name)


def _selected(rows: DataFrame, keys: list[str], wanted: Callable[[DataFrame], DataFrame], depth: int = 0) -> DataFrame:
    """(keys.., pick, _v): the values at the 0-based places of ``wanted``, (keys.., pick, at) made from (keys.., _n).

    Approximate quantiles cut each group into bins, a value that is one of them having a bin of its own. Exact counts of
    the bins tell which one holds a place; only rows of such bins with more than one value go on, to counts by value, or
    once more through this function where a bin has over WIDE rows. Quantiles steer the work, never the result.
    """
    levels = [i / LEVELS for i in range(1, LEVELS)]
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", levels, 20 * LEVELS).alias("_edges")))
    binned = rows.join(small(groups.select(*keys, "_edges")), keys).withColumn("_bin", F.lit(0))
    half = LEVELS // 2
    while half:  # binary search, in generated code, for the number of quantiles below the value
        binned = binned.withColumn("_bin", F.col("_bin") + F.when(F.get("_edges", F.col("_bin") + (half - 1)) < F.col("_v"), half).otherwise(0))
        half //= 2
    own = F.coalesce(F.get("_edges", F.col("_bin")) == F.col("_v"), F.lit(False)).cast("int")
    binned = binned.withColumn("_bin", 2 * F.col("_bin") + own).drop("_edges")
    so_far = lambda part, by: F.coalesce(F.sum("_c").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    here = (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_c"))
    slots = cells.withColumn("_before", so_far(keys, "_bin")).join(wanted(groups.select(*keys, "_n")), keys).where(here)
    slots = cut(slots.withColumn("at", F.col("at") - F.col("_before")).drop("_before"))
    found = slots.where("_lo = _hi").select(*keys, "pick", F.col("_lo").alias("_v"))
    mixed = slots.where("_lo < _hi").select(*keys, "_bin", "pick", "at", "_c")
    widest = mixed.agg(F.max("_c")).first()[0]
    if widest is None:
        return found
    inner = [*keys, f"_bin{depth}"]
    mixed = mixed.withColumnRenamed("_bin", inner[-1])
    inside = binned.withColumnRenamed("_bin", inner[-1]).join(small(mixed.select(*inner).distinct()), inner, "left_semi")
    if widest > WIDE:
        hit = _selected(inside, inner, lambda _sizes: mixed.drop("_c"), depth + 1)
    else:
        counts = inside.groupBy(*inner, "_v").agg(F.count("*").alias("_c"))
        hit = counts.withColumn("_before", so_far(inner, "_v")).join(mixed.drop("_c"), inner).where(here)
    return found.unionByName(hit.select(*keys, "pick", "_v"))


def nth_values(
    df: DataFrame, value: str, picks: dict[str, object], keys: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """Order statistics of ``value`` per group (W02), exact.

    ``picks`` maps an output name to a function of the group size ``n`` (a Column) that gives a
    0-based index into the ascending values. Nulls are left out. ``df`` is read three times:
    its keys and values are written once, unless it is ``stored`` and cheap to read again.
    """
    keys = list(keys)
    known = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    rows = known if stored else cut(known)
    by = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    places = F.array(*(F.struct(F.lit(k).alias("pick"), fn(F.col("_n")).cast("bigint").alias("at")) for k, fn in picks.items()))
    got = _selected(rows, by, lambda sizes: sizes.select(*by, F.inline(places)))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("pick") == k, F.col("_v"))).alias(k) for k in picks])


def medians(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median per group, mean of the two middle values for even sizes."""
    mid = nth_values(
        df, value, {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)}, keys
    )
    return mid.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def eps_percentile(kdist: DataFrame, p: float, value: str = "kdist_km") -> DataFrame:
    """One row: the value at rank round((n-1)p), half up."""
    return nth_values(kdist, value, {"eps_km": lambda n: half_up((n - 1) * F.lit(float(p)))})


def elbow(kdist: DataFrame, value: str = "kdist_km", exact: bool = False) -> DataFrame:
    """One row: the value at the rank farthest from the chord of the sorted curve.

    The value returned is the one after the farthest rank, as the published tool does;
    ``exact=True`` returns the farthest rank itself.
    """
    # Written once: the curve is read for its ends, its farthest rank and the value there.
    curve = cut(ranked(kdist.select(value), [value], name="k"))
    ends = curve.agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    n, lo, hi = (ends.select(c).scalar() for c in ("n", "lo", "hi"))
    inner = curve.withColumn("_n", n).withColumn("_lo", lo).withColumn("_hi", hi)
    a, b = F.col("_hi") - F.col("_lo"), 1 - F.col("_n")
    c = F.col("_n") * F.col("_lo") - F.col("_hi")
    gap = F.abs(a * F.col("k") + b * F.col(value) + c) / F.sqrt(a * a + b * b)
    far = (
        inner.where((F.col("k") > 1) & (F.col("k") < F.col("_n")))
        .select("k", gap.alias("gap"))
        .where(F.col("gap") > 0)
        .agg(F.coalesce(F.max_by("k", F.struct("gap", -F.col("k"))), F.lit(1)).alias("k"))
    )
    place = far.scalar() + (0 if exact else 1)
    place = F.least(place, n)
    return curve.where(F.col("k") == place).select(F.col(value).alias("eps_km"))


def kdist_curve(kdist: DataFrame, value: str = "kdist_km") -> DataFrame:
    """(rank, distance) points of the k-distance plot (W07); join the eps row of W01 or W03 to mark it."""
    return ranked(kdist.select(value), [value]).select("rank", value)
