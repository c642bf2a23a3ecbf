"""Waveform samples: (trace_id, i, y) rows, i counted from 0 inside the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.measure import col

CHUNK = 100_000


def detrend(waves: DataFrame) -> DataFrame:
    """Subtract the least-squares line of each trace."""
    x = F.col("i").cast("double")
    line = waves.groupBy("trace_id").agg(
        F.coalesce(F.regr_slope("y", x), F.lit(0.0)).alias("_b"),
        F.coalesce(F.regr_intercept("y", x), F.avg("y")).alias("_a"),
    )
    return (
        waves.join(line, "trace_id")
        .withColumn("y", F.col("y") - (F.col("_a") + F.col("_b") * x))
        .drop("_a", "_b")
    )


def normalize_trace(waves: DataFrame) -> DataFrame:
    """y / (2 max|y|) per trace; a flat trace becomes 0."""
    peak = waves.groupBy("trace_id").agg(F.max(F.abs("y")).alias("_peak"))
    return (
        waves.join(peak, "trace_id")
        .withColumn("y", F.when(F.col("_peak") > 0, F.col("y") / (2 * F.col("_peak"))).otherwise(0.0))
        .drop("_peak")
    )


def _moving_mean(waves: DataFrame, half: str, chunk: int) -> DataFrame:
    """Mean over samples i-half .. i+half-1, cut at the ends of the trace.

    Running sums inside chunks of a trace, then the sums of the earlier chunks of the trace on
    top; the mean is the difference of two running sums, found by equi joins on (trace, i). A
    long trace is many chunks, and each trace may have its own width.
    """
    inner = Window.partitionBy("trace_id", "_chunk").orderBy("i")
    part = waves.withColumn("_chunk", F.floor(F.col("i") / chunk))
    part = part.withColumn("_sum", F.sum("y").over(inner))
    outer = Window.partitionBy("trace_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        part.groupBy("trace_id", "_chunk").agg(F.sum("y").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(outer), F.lit(0.0)))
        .select("trace_id", "_chunk", "_base")
    )
    run = part.join(earlier, ["trace_id", "_chunk"]).withColumn("_run", F.col("_base") + F.col("_sum"))
    # Each sample is asked for by at most two others: as their upper and as their lower bound.
    sums = run.select("trace_id", F.col("i").alias("_at"), "_run")
    hi = F.least(F.col("i") + F.col(half), F.col("_n")) - 1
    lo = F.greatest(F.col("i") - F.col(half), F.lit(0)) - 1
    return (
        waves.withColumns({"_hi": hi, "_lo": lo})
        .join(sums.select("trace_id", F.col("_at").alias("_hi"), F.col("_run").alias("_top")), ["trace_id", "_hi"], "left")
        .join(sums.select("trace_id", F.col("_at").alias("_lo"), F.col("_run").alias("_low")), ["trace_id", "_lo"], "left")
        .withColumn("_mean", (F.col("_top") - F.coalesce("_low", F.lit(0.0))) / (F.col("_hi") - F.col("_lo")))
        .drop("_hi", "_lo", "_top", "_low")
    )


def _chunked_mean(waves: DataFrame, half: int, chunk: int) -> DataFrame:
    """The same mean for one width: windows over chunks that carry ``half`` samples of both neighbours."""
    chunk = max(chunk, 4 * half)
    own = F.floor(F.col("i") / chunk)
    first, last = F.floor((F.col("i") - half) / chunk), F.floor((F.col("i") + half) / chunk)
    w = Window.partitionBy("trace_id", "_chunk").orderBy("i").rowsBetween(-half, half - 1)
    return (
        waves.withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_mean", F.avg("y").over(w))
        .where(F.col("_chunk") == own)
        .drop("_chunk")
    )


def bandpass(
    waves: DataFrame, fmin: float, fmax: float, delta: float | str | Column = 0.01, chunk: int = CHUNK
) -> DataFrame:
    """High pass by subtracting a moving mean, then low pass by a moving mean.

    With one sampling interval and ``fmin`` wide enough to fit every trace the widths are
    constants; ``delta`` may also be a column, then each trace has its own widths.
    """
    sizes = waves.groupBy("trace_id").agg((F.max("i") + 1).alias("_n"))
    rows = waves.join(sizes, "trace_id")
    dt = col(delta) if not isinstance(delta, float) else F.lit(delta)
    width = F.greatest(F.floor(1.0 / (fmin * dt) + 0.5), F.lit(1))
    width = F.least(width, F.floor(F.col("_n") / 2))
    # A half width of 0 would leave an empty window; 1 is the smallest useful one.
    rows = rows.withColumn("_half", F.greatest(F.floor(width / 2), F.lit(1)))
    out = _moving_mean(rows, "_half", chunk)
    out = out.withColumn("y", F.col("y") - F.col("_mean")).drop("_mean", "_half")
    if isinstance(delta, float):
        nyquist = 0.5 / delta
        low = int(nyquist / (fmax * delta) + 0.5)
        if fmax >= nyquist or low <= 1:
            return out.drop("_n")
        half = max(low // 2, 1)
        return _chunked_mean(out, half, chunk).withColumn("y", F.col("_mean")).drop("_mean", "_n")
    nyquist = 0.5 / dt
    low = F.floor(nyquist / (fmax * dt) + 0.5)
    out = out.withColumn("_low", F.when(nyquist > fmax, low).otherwise(1))
    out = out.withColumn("_half", F.greatest(F.floor(F.col("_low") / 2), F.lit(1)))
    out = _moving_mean(out.withColumnRenamed("_low", "_width"), "_half", chunk)
    return out.withColumn("y", F.when(F.col("_width") > 1, F.col("_mean")).otherwise(F.col("y"))).drop(
        "_mean", "_half", "_width", "_n"
    )
