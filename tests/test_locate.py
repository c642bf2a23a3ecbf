import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shakegrid.functions import geodesic
from shakegrid.operators import joins
from shakegrid.plans import locate, traveltime as tt


def stations(spark):
    rows = [(i, f"S{i:02d}", 38.6 + 0.35 * (i % 4), 141.8 + 0.4 * (i // 4), 0.1 * i, 0.02 * i) for i in range(13)]
    return spark.createDataFrame(rows, "stn_idx int, code string, lat double, lon double, dep_km double, sc double")


def truth(spark, n=50):
    rng = np.random.default_rng(1)
    return spark.createDataFrame(
        [(i, float(rng.uniform(38.8, 39.8)), float(rng.uniform(142.0, 143.0)), float(rng.uniform(8, 30))) for i in range(n)],
        "event_id int, lat double, lon double, depth_km double",
    )


def exact_lags(spark, model, ev, st):
    pairs = joins.station_pairs(st).select("stn_k", "stn_l")
    w = ev.withColumn("_1", F.lit(1)).join(pairs.withColumn("_1", F.lit(1)), "_1").drop("_1")
    raw = w.select("event_id", ((F.col("stn_k") * 13 + F.col("stn_l"))).alias("seq"), "stn_k", "stn_l", F.lit(0.0).alias("lag"), F.lit(1.0).alias("weight"))
    obs = locate.observations(raw, st)
    calc = locate.residual_table(obs, ev, model).select("event_id", "seq", "calc")
    return raw.join(calc, ["event_id", "seq"]).withColumn("lag", F.col("calc")).drop("calc")


@pytest.fixture(scope="module")
def problem(spark, tmp_path_factory):
    model = tt.StraightModel([(0.0, 3.2), (20.0, 3.6), (60.0, 4.4)])
    st, ev = stations(spark), truth(spark)
    path = str(tmp_path_factory.mktemp("lags") / "p")
    exact_lags(spark, model, ev, st).write.parquet(path)
    return model, st, ev, spark.read.parquet(path)


def km_off(got, ev):
    both = got.select("event_id", F.col("lat").alias("a"), F.col("lon").alias("b"), F.col("depth_km").alias("z")).join(ev, "event_id")
    return both.select(geodesic("a", "b", "lat", "lon")["km"].alias("km"), F.abs(F.col("z") - F.col("depth_km")).alias("dz")).toPandas()


def test_least_squares_finds_the_true_place(spark, problem):
    model, st, ev, lags = problem
    obs = locate.observations(lags, st)
    start = ev.withColumns({"lat": F.col("lat") + 0.05, "lon": F.col("lon") - 0.04, "depth_km": F.col("depth_km") + 3})
    got, used = locate.locate_lsq(start, obs, model, rounds=1)
    off = km_off(got, ev)
    assert len(off) == 50 and off.km.max() < 1e-3 and off.dz.max() < 1e-2
    assert used.count() == lags.count()


def test_least_squares_drops_outliers(spark, problem):
    model, st, ev, lags = problem
    noisy = lags.withColumn("lag", F.col("lag") + F.when(F.col("seq") == 1, 30.0).otherwise(0.0))
    got, used = locate.locate_lsq(ev, locate.observations(noisy, st), model, rounds=3, wgs84=False)
    assert km_off(got, ev).km.max() < 1.0
    notes = locate.excluded_pairs(used.where("seq = 1"), st).toPandas()
    assert len(notes) == 50 and set(notes.note) == {"2:S00-S01"}


def test_search_gets_closer_and_posterior_covers(spark, problem):
    model, st, ev, lags = problem
    few = ev.where("event_id < 8")
    obs = locate.observations(lags.where("event_id < 8"), st)
    start = few.withColumn("lat", F.col("lat") + 0.3)
    got = locate.locate_search(start, obs, model, stages=4, n=800, wgs84=False)
    again = locate.locate_search(start, obs, model, stages=4, n=800, wgs84=False)
    assert got.exceptAll(again).count() == 0
    # The last box is +-0.125 degrees.
    assert km_off(got, few).km.max() < 0.125 * 111.32 * 2
    post = locate.posterior(few, obs, model, n=400, spread=(0.02, 2.0), wgs84=False)
    assert km_off(post, few).km.max() < 5
    assert post.where((F.col("ess") > 1) & (F.col("err_lat_km") > 0)).count() == 8


def test_geodesic(spark):
    # Published lines of the WGS84 inverse problem (km).
    rows = [(0.0, 0.0, 0.0, 1.0, 111.319491), (0.0, 0.0, 1.0, 0.0, 110.574389), (-37.95103341, 144.42486789, -37.65282114, 143.92649553, 54.972271)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, km double")
    bulk = tt.with_geodesic(df, "a", "b", "c", "d", "g", "az")
    for r in bulk.withColumn("one", geodesic("a", "b", "c", "d")).collect():
        assert abs(r.g - r.km) < 1e-2 and abs(r.g - r.one.km) < 1e-6 and abs(r.az - r.one.azimuth) < 1e-6


def test_grid_matches_closed_forms(spark):
    flat = spark.createDataFrame([(0.0, 3.5), (200.0, 3.5)], "depth_km double, vs double")
    grid = tt.travel_time_grid(flat, (100.0, 5.0), (20.0, 5.0), (0.0, 1.0))
    for r in grid.where("stn_cell = 0").collect():
        assert abs(r.t000 - math.hypot(r.dist_cell * 5, r.dep_cell * 5) / 3.5) < 1e-3
    # Constant gradient: the time between two points of a half space v = v0 + g z.
    v0, g = 3.0, 0.05
    lin = spark.createDataFrame([(0.0, v0), (300.0, v0 + g * 300)], "depth_km double, vs double")
    grid = tt.travel_time_grid(lin, (200.0, 5.0), (40.0, 5.0), (0.0, 1.0))
    for r in grid.where("stn_cell = 0").collect():
        z, x = r.dep_cell * 5, r.dist_cell * 5
        want = math.acosh(1 + g * g * (x * x + z * z) / (2 * v0 * (v0 + g * z))) / g
        assert abs(r.t000 - want) < 2e-3, (x, z, r.t000, want)


def test_grid_model_slopes_and_envelope(spark, tmp_path):
    steps = spark.createDataFrame([(0.0, 3.2), (15.0, 3.2), (15.000001, 3.9), (24.4, 3.9), (24.400001, 4.49), (80.0, 4.48), (220.0, 4.44), (220.000001, 4.64), (670.0, 5.57)], "depth_km double, vs double")
    tt.travel_time_grid(steps, (130.0, 2.0), (40.0, 2.0), (0.2, 0.1)).write.parquet(str(tmp_path / "g"))
    model = tt.GridModel(spark.read.parquet(str(tmp_path / "g")))
    q = spark.createDataFrame([(float(d), 30.0, 0.1, 0.0) for d in (10, 30, 50, 100, 119)], "dist_km double, depth_km double, stn_dep double, sc double")
    for r in tt.travel_times(q, model).collect():
        path = math.hypot(r.dist_km, 29.9)
        assert max(0.02, min(r.dist_km / 10, path / 40)) <= r.tt <= path / 2 + 100
        assert path / 4.7 < r.tt < path / 3.1
    for r in model.add_times(q, "dist_km", "depth_km", "stn_dep", "s").collect():
        assert 0 < r.s_px < 1 / 3.2 + 1e-6


CRUST = [(0.0, 3.2), (15.0, 3.2), (15.000001, 3.9), (35.0, 3.9), (35.000001, 4.49), (150.0, 4.6)]


def test_grid_edges_and_beyond(spark):
    layers = spark.createDataFrame(CRUST, "depth_km double, vs double")
    grid = tt.travel_time_grid(layers, (60.0, 10.0), (40.0, 10.0), (2.0, 1.0), rays=16, up_rays=60).cache()
    rows = [(60.0, 40.0, 2.0), (60.0, 0.0, 0.0), (0.0, 40.0, 1.3), (35.0, 12.0, 0.7), (61.0, 5.0, 0.0), (5.0, 75.0, 0.0), (5.0, 5.0, 3.5)]
    q = spark.createDataFrame([(*r, 0.0) for r in rows], "dist_km double, depth_km double, stn_dep double, sc double")
    inside = tt.GridModel(grid).add_times(q, "dist_km", "depth_km", "stn_dep", "s").collect()
    assert [r.s_t is None for r in inside] == [False] * 4 + [True] * 3
    every = tt.GridModel(grid, layers).add_times(q, "dist_km", "depth_km", "stn_dep", "s").collect()
    assert [r.s_straight for r in every] == [False] * 4 + [True] * 3
    for r in every:
        path = math.hypot(r.dist_km, r.depth_km - r.stn_dep)
        assert path / 4.7 < r.s_t < path / 3.1 and r.s_px is not None and r.s_pz is not None


def test_no_event_is_lost(spark):
    layers = spark.createDataFrame(CRUST, "depth_km double, vs double")
    st = spark.createDataFrame([(i, 38.0 + 0.2 * (i % 3), 141.0 + 0.2 * (i // 3), 1.0 + 0.1 * i, 0.0) for i in range(9)], "stn_idx int, lat double, lon double, dep_km double, sc double")
    ev = spark.createDataFrame([(1, 38.2, 141.2, 10.0), (2, 38.3, 141.1, 80.0), (3, 40.9, 141.2, 20.0), (4, 38.1, 141.3, 5.0)], "event_id bigint, lat double, lon double, depth_km double")
    model = tt.grid_model(layers, ev, st, steps=(20.0, 10.0, 1.0), rays=16, up_rays=60)
    lags = [(e, n, n, n + 1, 0.1 * n, 1.0) for e in (1, 2, 3) for n in range(8)]
    obs = locate.observations(spark.createDataFrame(lags, "event_id bigint, seq int, stn_k int, stn_l int, lag double, weight double"), st)
    assert locate.residual_table(obs, ev, model, wgs84=False).count() == 24
    found = locate.locate_search(ev, obs, model, n=31, wgs84=False)
    square, _ = locate.locate_lsq(ev, obs, model, rounds=1, max_iter=4, wgs84=False)
    post = locate.posterior(ev, obs, model, n=40, wgs84=False)
    for got in (found, square, post):
        rows = {r.event_id: r for r in got.collect()}
        assert sorted(rows) == [1, 2, 3, 4] and rows[4].mode == "ERR" and (rows[4].lat, rows[4].depth_km) == (38.1, 5.0)
    rows = {r.event_id: r for r in square.collect()}
    assert all(rows[e].n_used == 8 and rows[e].n_lost == 0 for e in (1, 2, 3)) and rows[4].n_used == 0
    assert {r.evaluations for r in found.where("event_id < 4").collect()} == {32}


def test_a_step_that_loses_lags_is_not_taken(spark):
    """Two stations lie far west, beyond a table without fallback; lags pull the event east."""
    layers = spark.createDataFrame(CRUST, "depth_km double, vs double")
    st = spark.createDataFrame([(i, 38.0 + 0.1 * i, lon, 0.0, 0.0) for i, lon in enumerate((141.0, 141.1, 141.2, 139.72, 139.73))], "stn_idx int, lat double, lon double, dep_km double, sc double")
    ev = spark.createDataFrame([(1, 38.2, 141.05, 10.0)], "event_id bigint, lat double, lon double, depth_km double")
    pairs = [(a, b) for a in range(5) for b in range(a)]
    lags = [(1, n, b, a, -3.0 if a < 3 else 9.0, 1.0) for n, (a, b) in enumerate(pairs)]
    obs = locate.observations(spark.createDataFrame(lags, "event_id bigint, seq int, stn_k int, stn_l int, lag double, weight double"), st)
    grid = tt.travel_time_grid(layers, (125.0, 5.0), (100.0, 10.0), (1.0, 1.0), rays=16, up_rays=60).cache()
    got, used = locate.locate_lsq(ev, obs, tt.GridModel(grid), rounds=1, max_iter=12, wgs84=False)
    row = got.first()
    assert row.n_used == 10 and row.n_lost == 0 and used.where("calc is null").count() == 0


def test_places_are_summed_where_the_lags_lie(spark, problem, monkeypatch):
    """Neither places nor samples are shuffled or written, and events with many chunks get the same results."""
    model, st, ev, lags = problem
    few, some = ev.where("event_id < 6").withColumn("lat", F.col("lat") + 0.1), lags.where("event_id < 6")
    obs = locate.observations(some, st)
    written = []
    monkeypatch.setattr(locate, "cut", lambda df: written.append(df.columns) or df.localCheckpoint())
    post = locate.posterior(few, obs, model, n=60, spread=(0.05, 2.0), wgs84=False)
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert not written and not [line for line in plan.splitlines() if "Exchange" in line and "ord#" in line]
    search = locate.locate_search(few, obs, model, stages=2, n=40, wgs84=False)
    monkeypatch.setattr(locate, "CHUNK", 10)
    monkeypatch.setattr(locate, "PLACES", 10)
    obs = locate.observations(some, st)
    assert obs.agg(F.max("chunk")).first()[0] > 3
    again = locate.posterior(few, obs, model, n=60, spread=(0.05, 2.0), wgs84=False), locate.locate_search(few, obs, model, stages=2, n=40, wgs84=False)
    for one, two in zip((post, search), again):
        a, b = (df.toPandas().sort_values("event_id").reset_index(drop=True) for df in (one, two))
        assert len(a) == 6
        pd.testing.assert_frame_equal(a, b, rtol=1e-6)


def test_observations_are_packed_and_stay(spark, problem):
    """Lags are a bucketed table: less than half of a checkpoint's size, and a join by event does not move them."""
    import os

    _model, st, ev, lags = problem
    obs = locate.observations(lags, st)
    size = lambda d: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(d) for f in fs)
    files = obs.inputFiles()
    assert files and size(os.path.dirname(files[0]).removeprefix("file:")) < obs.count() * 60
    plan = locate._meet(obs, ev.join(locate._chunks(obs), "event_id")).hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan
    assert set(obs.columns) >= {"event_id", "chunk", "k_lat", "l_sc"}


def test_samples_are_weighed_like_one_event_after_another():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    event = rng.integers(0, 5, 400) * 1_000_003
    rows = pd.DataFrame({"event_id": event, "ord": np.arange(400), "lat": rng.normal(38, 1, 400), "lon": rng.normal(141, 1, 400), "depth_km": rng.normal(9, 3, 400),
                         "loglik": rng.normal(0, 3, 400).round(1), "_lw": rng.normal(0, 400, 400).round(0)})
    batches = pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=70)
    got = pa.Table.from_batches(list(locate.weighed(iter(batches)))).to_pandas().set_index("event_id")
    assert len(got) == 5 and list(locate.weighed(iter([]))) == []
    for i, own in rows.groupby("event_id"):
        w, top = np.exp(own._lw - own._lw.max()), own.sort_values(["loglik", "ord"], ascending=[False, True]).iloc[0]
        r = got.loc[i]
        assert r.n_samples == len(own) and math.isclose(r.ess, w.sum() ** 2 / (w * w).sum()) and (r.lat, r.loglik) == (top.lat, top.loglik)
        for c in locate.PLACE:
            mean = (w * own[c]).sum() / w.sum()
            assert math.isclose(r[f"mean_{c}"], mean) and math.isclose(r[f"sd_{c}"], np.sqrt((w * (own[c] - mean) ** 2).sum() / w.sum()), abs_tol=1e-6)
