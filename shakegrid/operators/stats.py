"""Catalogue statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import DEG_KM
from ..functions.measure import finite
from .filters import quality_label
from .ranks import medians, nth_values

MEASURES = ["lat", "lon", "depth_km", "err_lat_km", "err_lon_km", "err_dep_km", "rms", "cid"]


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., column, value) rows, one scan for all columns."""
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in cols
        ]
    )
    return df.select(*keep, F.inline(parts))


def describe_columns(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """Count, extremes, mean, median, population sd and index quartiles per column.

    A missing cluster id counts as -1.
    """
    if "cid" in cols:
        df = df.withColumn("cid", F.coalesce("cid", F.lit(-1)))
    values = melt(df, cols).where(F.col("value").isNotNull())
    basic = values.groupBy("column").agg(
        F.count("*").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
    )
    order = nth_values(
        values,
        "value",
        {
            "_a": lambda n: F.floor((n - 1) / 2),
            "_b": lambda n: F.floor(n / 2),
            "q1": lambda n: F.floor(n / 4),
            "q3": lambda n: F.floor(n * 3 / 4),
        },
        ["column"],
        stored=True,
    )
    return basic.join(order, "column").select(
        "column", "n", "min", "max", "mean",
        ((F.col("_a") + F.col("_b")) / 2).alias("median"),
        "sd", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
    )


def robust_range(df: DataFrame, value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """One row (lo, hi): percentile range of the finite values, widened when flat."""
    lo, hi = sorted((min(max(lo, 0.0), 1.0), min(max(hi, 0.0), 1.0)))
    ends = nth_values(
        df.where(finite(F.col(value).cast("double"))),
        value,
        {"lo": lambda n: F.floor((n - 1) * F.lit(lo)), "hi": lambda n: F.ceil((n - 1) * F.lit(hi))},
        stored=True,
    )
    # 64 units in the last place of a double.
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("lo"))) - 46)
    eps = F.when(F.abs("lo") > 1e-12, ulp).otherwise(1e-6)
    flat = F.col("lo") == F.col("hi")
    return ends.select(
        F.when(F.col("lo").isNull(), 0.0).when(flat, F.col("lo") - eps).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("hi").isNull(), 1.0).when(flat, F.col("hi") + eps).otherwise(F.col("hi")).alias("hi"),
    )


def histogram(
    df: DataFrame, cols: Sequence[str], mode: str = "report", zoom: tuple[float, float] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Counts per (series, bin) on one shared range; empty bins included.

    ``report`` uses the true range with a missing cluster id as -1; ``viewer`` uses the 2-98 %
    range with values clamped into the end bins, or ``zoom`` with outside values dropped.
    """
    keep = list(keep)
    if "cid" in cols and mode == "report":
        df = df.withColumn("cid", F.coalesce("cid", F.lit(-1)))
    values = melt(df, cols, keep).where(F.col("value").isNotNull())
    # Sturges' rule counts every stored value, the range only the finite ones.
    total = values.agg(F.count("*").alias("n"))
    if mode == "viewer":
        values = values.where(finite("value"))
        span = total.select(F.lit(zoom[0]).alias("lo"), F.lit(zoom[1]).alias("hi")) if zoom else robust_range(values, "value")
    else:
        span = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bins = F.least(
        F.greatest(F.ceil(1 + F.log10("n") / F.log10(F.lit(2.0))), F.lit(5)), F.lit(30)
    )
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) / F.col("bins")
    # Two tables of one row each become one struct that travels as a scalar.
    one = F.lit(1).alias("_one")
    shape = total.select("n", one).join(span.select("lo", "hi", one), "_one").withColumn("bins", bins)
    shape = shape.select(F.struct("lo", "hi", "bins", width.alias("width"))).scalar()
    lo, hi, width, bins = (shape[c] for c in ("lo", "hi", "width", "bins"))
    v = F.col("value")
    if zoom and mode == "viewer":
        values = values.where(v.between(*zoom))
    elif mode == "viewer":
        v = F.greatest(F.least(v, hi), lo)
    series = [*keep, "column"]
    counted = (
        values.withColumn("bin", F.least(F.floor((v - lo) / width), bins - 1))
        .groupBy(*series, "bin")
        .agg(F.count("*").alias("n"))
    )
    # Dense bins: one row per series and bin, at most 30 per series.
    frame = (
        counted.select(*series)
        .distinct()
        .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), bins - 1)))
    )
    return (
        frame.join(counted, [*series, "bin"], "left")
        .select(
            *series, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
            (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def cluster_sizes(cat: DataFrame) -> DataFrame:
    """Events per cluster; cid 0 is noise."""
    return cat.groupBy("cid").agg(F.count("*").alias("n_events"))


def ref_point(stations: DataFrame) -> DataFrame:
    """One row: median latitude and longitude of the net."""
    pair = melt(stations, ["lat", "lon"])
    return medians(pair, "value", ["column"]).agg(
        F.max(F.when(F.col("column") == "lat", F.col("median"))).alias("lat"),
        F.max(F.when(F.col("column") == "lon", F.col("median"))).alias("lon"),
    )


def bottom_depth(stations: DataFrame) -> DataFrame:
    """One row: shallowest depth a hypocenter may have."""
    return stations.agg(
        (F.greatest(F.coalesce(F.max("dep_km"), F.lit(0.0)), F.lit(0.0)) + 0.01).alias("bottom_km")
    )


def event_lag_counts(cat: DataFrame, lags: DataFrame) -> DataFrame:
    """Lag rows and used stations per event, zero for events without lags."""
    # The distinct (event, station) pairs are thinned before the shuffle on the event.
    used = (
        lags.select("event_id", F.explode(F.array("stn_k", "stn_l")).alias("stn"))
        .distinct()
        .groupBy("event_id")
        .agg(F.count("*").alias("n_stations"))
    )
    rows = lags.groupBy("event_id").agg(F.count("*").alias("n_lags"))
    return (
        cat.select("event_id")
        .join(rows, "event_id", "left")
        .join(used, "event_id", "left")
        .select(
            "event_id",
            F.coalesce("n_lags", F.lit(0)).alias("n_lags"),
            F.coalesce("n_stations", F.lit(0)).alias("n_stations"),
            F.col("n_lags").isNotNull().alias("has_lags"),
        )
    )


def filter_report(cat: DataFrame, rms_max=None, loc_err_max=None) -> DataFrame:
    """One row: totals of the quality filter, each event counted under its first failing rule."""
    label = quality_label(rms_max, loc_err_max)
    return cat.agg(
        F.count("*").alias("total"),
        F.count_if(label == "passed").alias("passed"),
        F.count_if(label == "rms").alias("removed_rms"),
        F.count_if(label == "error").alias("removed_error"),
    )


def run_totals(summary: DataFrame) -> DataFrame:
    """Runs per status."""
    return summary.groupBy("status").agg(F.count("*").alias("n"))


def mad_weights(df: DataFrame, keys: Sequence[str], value: str = "residual", c: float = 4.685) -> DataFrame:
    """Biweight weights from the median absolute deviation of each group (A10)."""
    keys = list(keys)
    mid = medians(df, value, keys, "_mid")
    away = df.join(mid, keys).select(*keys, F.abs(F.col(value) - F.col("_mid")).alias("_away"))
    mad = medians(away, "_away", keys, "mad")
    scale = c * F.col("mad")
    u = F.when(scale > 0, F.col(value) / F.when(scale > 0, scale)).otherwise(
        F.when(F.col(value) == 0, 0.0).otherwise(2.0)
    )
    return df.join(mad, keys).withColumn(
        "weight", F.when(F.abs(u) > 1, 0.0).otherwise((1 - u * u) * (1 - u * u))
    )


def event_td_rms(td_resid: DataFrame, cat: DataFrame) -> DataFrame:
    """Root mean square of the residuals that touch an event; others keep their rms."""
    per_event = (
        td_resid.where(F.col("residual").isNotNull())
        .select(F.explode(F.array("eve0", "eve1")).alias("event_id"), "residual")
        .groupBy("event_id")
        .agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("_td_rms"))
    )
    return (
        cat.join(per_event, "event_id", "left")
        .withColumn("rms", F.coalesce("_td_rms", "rms"))
        .drop("_td_rms")
    )


def cluster_residual_trace(trace: DataFrame) -> DataFrame:
    """Residual norm per cluster and step, steps numbered on across the stages.

    ``trace`` has (cid, stage, step, residual) with ``step`` from 0 inside its stage.
    """
    # One row per cluster and stage takes part in the window, not the residuals themselves.
    w = Window.partitionBy("cid").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    offset = (
        trace.groupBy("cid", "stage")
        .agg((F.max("step") + 1).alias("_steps"))
        .withColumn("_before", F.coalesce(F.sum("_steps").over(w), F.lit(0)))
        .drop("_steps")
    )
    return (
        trace.join(offset, ["cid", "stage"])
        .groupBy("cid", (F.col("_before") + F.col("step")).alias("step"))
        .agg(F.sqrt(F.sum(F.col("residual") * F.col("residual"))).alias("residual_norm"))
    )


def posterior_summary(samples: DataFrame) -> DataFrame:
    """Mean, spread in km and best sample per event."""
    means = samples.groupBy("event_id").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("lat", "lon", "depth_km")],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in ("lat", "lon", "depth_km")],
        F.max_by(F.struct("lat", "lon", "depth_km", "loglik"), F.col("loglik")).alias("best"),
    )
    return means.select(
        "event_id", "n", "mean_lat", "mean_lon", "mean_depth_km",
        (F.col("sd_lat") * DEG_KM).alias("err_lat_km"),
        (F.col("sd_lon") * DEG_KM * F.cos(F.radians("best.lat"))).alias("err_lon_km"),
        F.col("sd_depth_km").alias("err_dep_km"),
        F.col("best.lat").alias("best_lat"), F.col("best.lon").alias("best_lon"),
        F.col("best.depth_km").alias("best_depth_km"), F.col("best.loglik").alias("best_loglik"),
    )


def best_candidate(c: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Smallest misfit per event, the first candidate wins a tie; the incumbent is ord 0."""
    rest = [x for x in c.columns if x not in keys]
    row = F.min_by(F.struct(*rest), F.struct("misfit", "ord"))
    known = c.where(F.col("misfit").isNotNull() | (F.col("ord") == 0))
    ranked_misfit = known.withColumn("misfit", F.coalesce("misfit", F.lit(float("inf"))))
    return ranked_misfit.groupBy(*keys).agg(row.alias("_b")).select(*keys, "_b.*")


def scatter_xy(catalogs: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """((source, x, y) without missing values, extents per source)."""
    xy = catalogs.select("source", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    xy = xy.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    both = xy.where(finite("x") & finite("y"))
    extent = both.groupBy("source").agg(
        F.count("*").alias("n"),
        *[fn(c).alias(f"{c}_{fn.__name__}") for c in ("x", "y") for fn in (F.min, F.max)],
    )
    return xy, extent


def elite_spread(candidates: DataFrame, n: int) -> DataFrame:
    """Spread in km of the ``n`` best candidates of each event."""
    # The rank limit is applied before the shuffle too, so a map task ships n rows per event.
    w = Window.partitionBy("event_id").orderBy("misfit", "ord")
    return (
        candidates.where(F.col("misfit").isNotNull())
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .groupBy("event_id")
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("_rank") == 1, F.col("lat"))).alias("_lat"),
            (F.stddev_pop("lat") * DEG_KM).alias("err_lat_km"),
            F.stddev_pop("lon").alias("_sd_lon"),
            F.stddev_pop("depth_km").alias("err_dep_km"),
        )
        .select(
            "event_id", "n", "err_lat_km",
            (F.col("_sd_lon") * DEG_KM * F.cos(F.radians("_lat"))).alias("err_lon_km"), "err_dep_km",
        )
    )
