"""Arrival picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import small

# Phase codes of the pick file.
PHASE_CODES = {"P": 0, "S": 1}


def latest_picks(log: DataFrame) -> DataFrame:
    """State of a pick log (A17): last time per (event, station, phase) after the last removal.

    The component is that of the first write after the last removal. Blanks in station names
    do not count.
    """
    log = log.withColumn("station", F.translate(F.col("station").cast("string"), " ", ""))
    key = ["event_id", "station", "phase"]
    removed = log.where(F.col("op") == "remove").groupBy(*key).agg(F.max("seq").alias("_gone"))
    return (
        log.where(F.col("op") == "set")
        .join(removed, key, "left")
        .where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
        .groupBy(*key)
        .agg(F.min_by("component", "seq").alias("component"), F.max_by("ts", "seq").alias("ts"))
    )


def with_reference_minute(picks: DataFrame) -> DataFrame:
    """Add the minute of the earliest P pick of the event; events without a P pick drop."""
    ref = (
        picks.where(F.col("phase") == "P")
        .groupBy("event_id")
        .agg(F.date_trunc("minute", F.min("ts").cast("timestamp")).alias("ref_minute"))
    )
    return picks.join(ref, "event_id")


def pick_offsets(picks: DataFrame, channels: DataFrame, delta: float = 0.0) -> DataFrame:
    """Seconds from the reference minute per mapped pick, and the same plus ``delta``.

    Times count in whole milliseconds. Picks before the minute or without a channel drop.
    """
    chan = small(channels.select(F.col("station").cast("string").alias("station"), "component", "channel"))
    codes = F.when(F.col("phase") == "P", PHASE_CODES["P"]).otherwise(PHASE_CODES["S"])
    offset = (
        F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("ref_minute"))
    ) / F.lit(1000.0)
    return (
        with_reference_minute(picks)
        .withColumn("station", F.col("station").cast("string"))
        .join(chan, ["station", "component"])
        .withColumn("offset_s", offset)
        .where(F.col("offset_s") >= 0)
        .select(
            "event_id", "ref_minute", "station", F.upper("channel").alias("channel"), codes.alias("phase_code"),
            "offset_s", (F.col("offset_s") + delta).alias("offset2_s"),
        )
    )
