import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shakegrid.functions import error_ellipse, minute_key, mode_code, mode_name, residual_weight, scaled, time_from_filename, to_compact, to_iso
from shakegrid.operators import filters, joins, picks, ranks, stats, waves


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(col).first()[0]


@pytest.mark.parametrize("iso,compact", [
    ("2024-01-15T12:30:45", "240115.123045"), ("1999-12-31T23:59:59", "991231.235959"), ("2000-06-01T00:00:00", "000601.000000"),
])
def test_time_strings(spark, iso, compact):
    assert one(spark, to_iso("c"), compact) == iso
    assert one(spark, to_iso("c"), iso) == iso
    assert one(spark, to_compact("c"), iso) == compact
    assert one(spark, to_compact("c"), iso + ".75") == compact
    assert one(spark, minute_key("c"), compact) == iso[:16]


def test_odd_times_and_names(spark):
    for bad in (None, ""):
        assert one(spark, to_iso("c"), bad) == "" and one(spark, to_compact("c"), bad) == ""
    assert one(spark, to_iso("c"), "next week") == "next week"
    assert one(spark, time_from_filename("c"), "x_000101.060000.dat") == "000101.060000"
    assert one(spark, time_from_filename("c"), "ev20000102030405.dat") == "000102.030405"
    assert one(spark, time_from_filename("c"), "plain.dat") == ""
    assert one(spark, mode_code("c"), "Triple Difference") == "TRD" and one(spark, mode_code("c"), "lmo") == "LMO"
    assert one(spark, mode_code("c"), "other") == "other" and one(spark, mode_name("c"), "de") == "Differential Evolution"


def test_numbers(spark):
    assert one(spark, scaled("c", 0, 10), 12.0, "double") == 1.0
    assert one(spark, scaled("c", 3, 3), 12.0, "double") == 0.5 and one(spark, scaled("c", 0, 1), math.nan, "double") == 0.5
    assert one(spark, residual_weight("c"), 0.0, "double") == pytest.approx(1e10)
    ring = one(spark, error_ellipse(F.lit(142.0), "c", F.lit(1.0), F.lit(2.0)), 39.0, "double")
    assert len(ring) == 33 and ring[0] == ring[-1] and max(p.lat for p in ring) == pytest.approx(39 + 2 / 111.32)
    assert one(spark, error_ellipse(F.lit(142.0), "c", F.lit(1.0), F.lit(math.nan)), 39.0, "double") is None


def test_screen_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "c")
    spark.createDataFrame([(1, 0.5, None), (2, 0.7, 3)], "event_id int, rms double, cid int").write.parquet(p)
    hit = filters.screen(spark.read.parquet(p), rms=(None, 0.7), cid=(0, None))
    assert [r.event_id for r in hit.collect()] == [2]
    plan = hit._jdf.queryExecution().explainString(hit.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(rms,0.7)" in plan and "GreaterThanOrEqual(cid,0)" in plan


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2003).alias("x"))
    hot = df.withColumn("g", F.when(F.col("x") < 1500, 0).otherwise(F.col("g")))
    want = sorted((r.g, r.x) for r in hot.collect())
    for parts in (1, 7):
        got = ranks.ranked(hot.repartition(parts), ["x"], ["g"]).collect()
        seen = {}
        for g, _x in want:
            seen[g] = seen.get(g, 0) + 1
        by = sorted((r.g, r["rank"], r.x) for r in got)
        assert [(g, x) for g, _r, x in by] == want
        assert all([r for g, r, _ in by if g == k] == list(range(1, n + 1)) for k, n in seen.items())


def test_mad_weights(spark):
    df = spark.createDataFrame([("a", v) for v in [0.0, 1.0, 2.0, 3.0, 100.0]] + [("b", 0.0)], "k string, residual double")
    w = {(r.k, r.residual): r.weight for r in stats.mad_weights(df, ["k"]).collect()}
    assert w[("a", 100.0)] == 0.0 and w[("a", 0.0)] == 1.0 and w[("b", 0.0)] == 1.0
    assert w[("a", 2.0)] == pytest.approx((1 - (2 / 4.685) ** 2) ** 2)


def test_hot_key_pairs_are_whole(spark, monkeypatch):
    # One station pair of one cluster, cut into many blocks: still every pair once.
    monkeypatch.setattr(joins, "BLOCK_ROWS", 7)
    cat = spark.range(60).selectExpr("id event_id", "cast(id as int) event_ord", "1 cid", "38.0 + id * 0.001 lat", "141.0d lon", "'LMO' mode")
    lags = spark.range(60).selectExpr("id event_id", "0 stn_k", "1 stn_l", "id * 0.1d lag")
    td = joins.triple_differences(cat, lags)
    assert td.count() == 60 * 59 // 2 and td.distinct().count() == td.count()
    near = joins.triple_differences(cat, lags, max_km=1.0)
    assert near.exceptAll(td.where("dist_km < 1")).count() == 0 and near.count() == td.where("dist_km < 1").count()
    # Swapping the order of the events changes the sign.
    back = joins.triple_differences(cat.withColumn("event_ord", -F.col("event_ord")), lags)
    flip = back.selectExpr("eve1 eve0", "eve0 eve1", "round(-td, 9) td")
    assert flip.exceptAll(td.selectExpr("eve0", "eve1", "round(td, 9) td")).count() == 0


def test_picks_with_tombstones(spark):
    t = [dt.datetime(2025, 1, 1, 0, 0, s) for s in range(6)]
    log = spark.createDataFrame(
        [(1, 0, "set", "A B", "Z", "P", t[1]), (1, 1, "remove", "AB", "Z", "P", t[1]), (1, 2, "set", "AB", "N", "P", t[2]),
         (1, 3, "set", "AB", "Z", "P", t[3]), (1, 4, "set", "C", "Z", "S", t[4]), (1, 5, "remove", "C", "Z", "S", t[4])],
        "event_id int, seq int, op string, station string, component string, phase string, ts timestamp")
    assert [tuple(r) for r in picks.latest_picks(log).collect()] == [(1, "AB", "P", "N", t[3])]


def test_bandpass_chunks_and_mixed_rates_agree(spark):
    df = spark.range(500).selectExpr("id % 2 trace_id", "cast(id div 2 as int) i", "sin(id * 0.7) + id * 0.01 y")
    a = waves.bandpass(df, 0.2, 0.1, 1.0).orderBy("trace_id", "i").toPandas()
    b = waves.bandpass(df, 0.2, 0.1, 1.0, chunk=16).orderBy("trace_id", "i").toPandas()
    c = waves.bandpass(df.withColumn("dt", F.lit(1.0)), 0.2, 0.1, "dt", chunk=16).orderBy("trace_id", "i").toPandas()
    assert len(a) == 500 and abs(a.y - b.y).max() < 1e-9 and abs(a.y - c.y).max() < 1e-9


@pytest.mark.parametrize("wide", [1 << 20, 50])
def test_order_statistics_by_selection(spark, monkeypatch, wide):
    """Ties, a value that most rows share, a group of one, nulls, and bins that are cut again."""
    monkeypatch.setattr(ranks, "WIDE", wide)
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.where(rng.random(4_000) < 0.9, 1.5, rng.normal(0, 5, 4_000)), "low": np.r_[np.zeros(900), np.arange(1, 90)],
        "plain": rng.normal(0, 1, 5_000), "one": np.array([-2.0]), "same": np.full(300, 7.0), "whole": rng.integers(-5, 5, 700).astype(float),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    at = {"first": lambda n: F.lit(0), "q1": lambda n: F.floor(n / 4), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    got = {r.k: r for r in ranks.nth_values(df, "x", at, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs, n = np.sort(xs), len(xs)
        assert (got[k].first, got[k].q1, got[k].mid, got[k].last, got[k].beyond) == (xs[0], xs[n // 4], xs[n // 2], xs[-1], None)
    every = np.sort(np.concatenate(list(groups.values())))
    whole = ranks.nth_values(df, "x", {"q": lambda n: F.floor(n / 3)}, stored=True).collect()
    assert [r.q for r in whole] == [every[len(every) // 3]]
    assert [r.q for r in ranks.nth_values(df.where("x > 1e9"), "x", {"q": lambda n: F.floor(n / 3)}).collect()] == [None]


def test_unformed_differences_agree_with_pairs(spark, monkeypatch):
    """What is told without pairs, or joined before them, is what the pairs tell: crowded keys, repeated rows, fixed events."""
    from shakegrid.functions import geo
    from shakegrid.operators import sets

    monkeypatch.setattr(joins, "BLOCK_ROWS", 3)
    cat = spark.range(60).selectExpr(
        "id event_id", "cast(id as int) event_ord", "cast(id % 4 as int) cid", "40 + (id % 11) * 0.001D lat", "140 + (id % 7) * 0.001D + if(id % 19 = 0, id * 0.1D, 0D) lon",
        "CASE id % 5 WHEN 0 THEN 'REF' WHEN 1 THEN if(id % 2 = 0, 'ERR', 'LMO') ELSE 'LMO' END mode")
    cat = cat.union(cat.where("event_id % 13 = 0"))
    lags = spark.range(240).selectExpr("id % 60 event_id", "cast(id % 2 as int) stn_k", "cast(2 + id % 3 as int) stn_l", "id * 0.01D lag")
    lags = lags.union(lags.where("event_id % 17 = 1"))
    times = cat.select("event_id").distinct().crossJoin(spark.range(5).selectExpr("cast(id as int) stn_idx")).where("event_id % 23 <> 2")
    times = times.selectExpr("event_id", "stn_idx", "event_id * 0.1D + stn_idx * stn_idx tt")
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for km in (None, 0.8):
        pairs, td = joins.differences(cat, lags, km, wgs84=False), joins.triple_differences(cat, lags, km, wgs84=False)
        a, b = cat.alias("a"), cat.alias("b")
        plain = lags.alias("p").join(a, F.expr("p.event_id = a.event_id")).join(
            lags.alias("q").join(b, F.expr("q.event_id = b.event_id")), F.expr("a.cid = b.cid and p.stn_k = q.stn_k and p.stn_l = q.stn_l and a.event_ord < b.event_ord"))
        plain = plain.where("a.cid > 0 and a.mode <> 'ERR' and b.mode <> 'ERR' and not (a.mode = 'REF' and b.mode = 'REF')")
        plain = plain.withColumn("dist_km", geo.haversine_km("a.lat", "a.lon", "b.lat", "b.lon")).where(F.lit(km is None) | (F.col("dist_km") < (km or 0)))
        assert td.count() > 50 and td.count() == plain.count()
        assert rows(td.select("eve0", "eve1", "td", "dist_km")) == rows(plain.selectExpr("p.event_id", "q.event_id", "q.lag - p.lag", "dist_km"))
        assert rows(joins.td_residual(pairs, times)) == rows(joins.td_residual(td, times))
        assert rows(filters.drop_ref_pairs(pairs, cat)) == rows(filters.drop_ref_pairs(td, cat))
        assert rows(sets.uncovered_events(cat, pairs)) == rows(sets.uncovered_events(cat, td))
        assert rows(joins.missing_td(cat, pairs)) == rows(joins.missing_td(cat, td))
        assert rows(pairs.counts()) == rows(td.groupBy("cid").agg(F.count("*").alias("n"), F.countDistinct("eve0").alias("n_first")))
