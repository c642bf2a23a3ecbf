"""Seismic tables derived from the driver's tables, the input of every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.ranks import ranked


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as int) stn_idx", "n_name code", "38e0 + (n_nationkey % 5) * 0.5e0 lat",
        "141e0 + (n_nationkey - n_nationkey % 5) * 0.1e0 lon", "(500e0 + 100e0 * n_nationkey) / 1000e0 dep_km",
        "n_nationkey * 0.02e0 pc", "n_nationkey * 0.034e0 sc",
    )


def catalog(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """Events; ``order`` adds ``event_ord``, the place in (time, id) order, by a spread-out sort."""
    orders = _table(spark, sf_dir, "orders")
    ordinal = ["event_ord"] if order else []
    if order:
        places = ranked(orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
        places = places.select("o_orderkey", (F.col("rank") - 1).cast("int").alias("event_ord"))
        orders = orders.join(places, "o_orderkey")
    return orders.selectExpr(
        "o_orderkey event_id", *ordinal, "o_orderdate ts",
        "38e0 + (o_custkey % 8) * 0.25e0 + ((o_orderkey * 7919) % 1000) * 0.00006e0 + CASE WHEN o_orderkey % 97 = 0"
        " THEN 5e0 + (o_orderkey % 30000) * 0.001e0 ELSE 0e0 END lat",
        "141e0 + ((o_custkey % 40) - (o_custkey % 8)) * 0.05e0 + ((o_orderkey * 104729) % 1013) * 0.00006e0 lon",
        "5e0 + ((o_orderkey * 31) % 400) / 10e0 depth_km", "((o_orderkey * 17) % 100) / 50e0 err_lat_km",
        "((o_orderkey * 19) % 100) / 50e0 err_lon_km", "((o_orderkey * 23) % 100) / 25e0 err_dep_km",
        "((o_orderkey * 13) % 1000) / 1000e0 rms",
        "CASE WHEN o_orderkey % 20 = 3 THEN 'REF' WHEN o_orderkey % 20 = 7 THEN 'ERR' WHEN o_orderstatus = 'F' THEN 'LMO'"
        " WHEN o_orderstatus = 'O' THEN 'TRD' ELSE 'GRD' END mode",
        "CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(o_custkey % 40 AS INT) + 1 END cid",
    )


def catalog_b(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    return catalog(spark, sf_dir, order).where("event_id % 3 = 0").withColumns(
        {"lat": F.expr("lat + 0.01e0"), "lon": F.expr("lon - 0.02e0"), "depth_km": F.expr("depth_km + 1e0"),
         "rms": F.expr("rms * 0.5e0"), "mode": F.lit("TRD")}
    )


def lags(spark: SparkSession, sf_dir: str, seq: bool = False) -> DataFrame:
    """Lag rows; ``seq`` numbers them inside their event."""
    items = _table(spark, sf_dir, "lineitem").where("l_suppkey % 25 <> l_partkey % 25")
    number = []
    if seq:
        items = ranked(
            items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"),
            ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey"],
        )
        number = ["cast(rank - 1 as int) seq"]
    return items.selectExpr(
        "l_orderkey event_id", *number, "CAST(least(l_suppkey % 25, l_partkey % 25) AS INT) stn_k",
        "CAST(greatest(l_suppkey % 25, l_partkey % 25) AS INT) stn_l",
        "round((l_discount - 0.05e0) * 100e0 + l_tax * 10e0, 3) lag", "l_quantity / 50e0 weight",
    )


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where("event_type IN ('click', 'view', 'error')").selectExpr(
        "user_id event_id", "event_id seq", "CASE WHEN event_type = 'error' THEN 'remove' ELSE 'set' END op",
        "CAST(event_id % 25 AS INT) station", "CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE 'N' END component",
        "CASE WHEN event_type = 'view' THEN 'S' ELSE 'P' END phase", "ts",
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS INT) station", "'Z' component", "lpad(CAST(n_nationkey AS string), 4, '0') channel"
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return ranked(events, ["ts", "event_id"], ["user_id"]).selectExpr(
        "user_id trace_id", "cast(rank - 1 as int) i", "ts", "value y"
    )
