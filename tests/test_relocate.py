import numpy as np
import pytest
from pyspark.sql import functions as F

from shakegrid.functions import geodesic
from shakegrid.operators import joins
from shakegrid.plans import locate, relocate, traveltime as tt
from test_locate import stations

MODEL = tt.StraightModel([(0.0, 3.2), (20.0, 3.6), (60.0, 4.4)])


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """30 events of one cluster, true places, start places with zero-mean shifts, exact lags."""
    rng = np.random.default_rng(5)
    n = 30
    true = np.c_[rng.normal(39.2, 0.03, n), rng.normal(142.4, 0.03, n), rng.normal(18, 2, n)]
    move = np.c_[rng.normal(0, 0.01, n), rng.normal(0, 0.01, n), rng.normal(0, 1, n)]
    move -= move.mean(0)
    cols = "event_id bigint, event_ord int, cid int, mode string, lat double, lon double, depth_km double, err_lat_km double, err_lon_km double, err_dep_km double, rms double"
    rows = lambda x, ref: [(i, i, 1, "REF" if i < ref else "LMO", *map(float, x[i]), 0.0, 0.0, 0.0, 0.5) for i in range(n)]
    st = stations(spark)
    ev = spark.createDataFrame(rows(true, 0), cols)
    one = F.lit(1).alias("_1")
    raw = ev.select("event_id", one).join(joins.station_pairs(st).select("stn_k", "stn_l", one), "_1").select(
        "event_id", (F.col("stn_k") * 13 + F.col("stn_l")).alias("seq"), "stn_k", "stn_l", F.lit(0.0).alias("lag"), F.lit(1.0).alias("weight"))
    lags = locate.residual_table(locate.observations(raw, st), ev, MODEL, wgs84=False).select("event_id", "stn_k", "stn_l", F.col("calc").alias("lag"))
    path = str(tmp_path_factory.mktemp("rel") / "lags")
    lags.write.parquet(path)
    lags = spark.read.parquet(path)

    def start(ref):
        off = np.where(np.arange(n)[:, None] < ref, 0, move)
        return spark.createDataFrame(rows(true + off, ref), cols)

    return st, ev, lags, start


def gaps(got, ev, relative):
    j = got.select("event_id", *[F.col(c).alias(f"g_{c}") for c in ("lat", "lon", "depth_km")]).join(ev, "event_id").toPandas()
    d = np.c_[(j.g_lat - j.lat) * 111, (j.g_lon - j.lon) * 86, j.g_depth_km - j.depth_km]
    return np.abs(d - d.mean(0) if relative else d).max()


@pytest.mark.parametrize("ref", [0, 3])
def test_known_shift(spark, shifted, ref):
    st, ev, lags, start = shifted
    cat = start(ref)
    td = joins.triple_differences(cat, lags, wgs84=False)
    assert td.count() == (30 * 29 // 2 - ref * (ref - 1) // 2) * 78
    got = relocate.relocate(cat, td.withColumn("residual", F.lit(None).cast("double")), st, MODEL, iterations=(3,), dist_km=(50.0,), damping=(0.0,), wgs84=False)
    assert got.count() == 30
    assert gaps(got, ev, relative=ref == 0) < 0.05
    assert got.where("mode = 'TRD' and rms < 0.01").count() == 30 - ref


def replayed(pdf, damp, zero_sum, tol=1e-6):
    """The solver's definition on dense arrays: (ids, x, variances along the steps, steps)."""
    ids = np.sort(pdf.loc[pdf.a == pdf.b, "a"].to_numpy())
    n = len(ids)
    ia, ib = np.searchsorted(ids, pdf.a), np.searchsorted(ids, pdf.b)
    m, rhs = np.zeros((n, 3, n, 3)), np.zeros((n, 3))
    blocks = pdf[relocate.BLOCK].to_numpy().reshape(-1, 3, 3)
    m[ia, :, ib, :] = blocks
    m[ib, :, ia, :] = blocks.transpose(0, 2, 1)
    for c in range(3):
        m[:, c, :, c] += float(zero_sum) + damp * damp * np.eye(n)
    own = (pdf.a == pdf.b).to_numpy()
    rhs[ia[own]] = pdf.loc[own, ["r0", "r1", "r2"]].to_numpy()
    k = np.linalg.inv(np.stack([m[i, :, i, :] for i in range(n)]))
    m, r = m.reshape(3 * n, 3 * n), rhs.ravel().copy()
    scaled = lambda r: np.einsum("nij,nj->ni", k, r.reshape(n, 3)).ravel()
    x, v, u = np.zeros(3 * n), np.zeros(3 * n), scaled(r)
    p, g, steps = u.copy(), r @ u, 0
    goal = g * tol * tol
    while g > goal:
        q = m @ p
        pap = p @ q
        x += g / pap * p
        v += p * p / pap
        r -= g / pap * q
        u = scaled(r)
        p, g, steps = u + r @ u / g * p, r @ u, steps + 1
    return ids, x.reshape(n, 3), v.reshape(n, 3), steps


def agree(system, damp, zero, zero_sum):
    pdf = system.toPandas()
    got = relocate.solve_clusters(system, damp, zero).toPandas()
    assert got.converged.all() and len(got) == ((pdf.a == pdf.b).sum())
    for cid, own in got.groupby("cid"):
        own = own.sort_values("event_id")
        ids, x, v, _ = replayed(pdf[pdf.cid == cid], damp, zero_sum)
        assert (own.event_id == ids).all()
        np.testing.assert_allclose(own[["d_lon", "d_lat", "d_dep"]], x, rtol=1e-4, atol=1e-6)
        np.testing.assert_allclose(own[["v_lon", "v_lat", "v_dep"]], v, rtol=0.05)


def test_conjugate_gradients_agree_with_dense(spark, shifted):
    st, _ev, lags, start = shifted
    cat = start(0).where("event_id < 12")
    td = joins.triple_differences(cat, lags, wgs84=False)
    state = cat.withColumn("target", F.lit(True))
    rows = relocate.td_rows(td, relocate.pair_places(td, st), state, MODEL, False).withColumn("w", F.lit(1.0))
    system = relocate.td_system(rows).cache()
    zero = spark.createDataFrame([(1, True)], "cid int, zero_sum boolean")
    agree(system, 1.0, zero, True)
    assert not relocate.solve_clusters(system, 1.0, zero, steps=2).toPandas().converged.any()


@pytest.fixture(scope="module")
def two_sizes(spark, tmp_path_factory):
    """Systems of 12 and of 1,200 targets in one table."""
    rng, rows = np.random.default_rng(11), []
    for cid, first, n in ((1, 0, 12), (2, 100, 1_200)):
        for a in range(n):
            for b in {int(x) for x in rng.integers(0, n, 5)} - {a}:
                g = rng.normal(0, 1, 6) * np.tile([90, 110, 1.0], 2) / 50
                rows.append((cid, first + a, first + b, True, True, *map(float, g), float(rng.normal()), 1.0))
    cols = [f"g{i}_{x} double" for i in (0, 1) for x in relocate.AXES]
    path = str(tmp_path_factory.mktemp("system") / "s")
    relocate.td_system(spark.createDataFrame(rows, f"cid int, eve0 bigint, eve1 bigint, t0 boolean, t1 boolean, {', '.join(cols)}, d double, w double")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("damp,zero_sum", [(1.0, False), (0.5, True)])
def test_one_solver_for_all_sizes(spark, two_sizes, damp, zero_sum):
    agree(two_sizes, damp, spark.createDataFrame([(1, zero_sum), (2, zero_sum)], "cid int, zero_sum boolean"), zero_sum)


def test_variances_reach_the_inverse_where_all_directions_are_visited(spark):
    """One event, three directions: the sum along the steps is the diagonal of the inverse."""
    rows = [(1, 1, 1, 2.0, 0.3, 0.1, 0.3, 1.0, 0.2, 0.1, 0.2, 3.0, 1.0, -2.0, 0.5)]
    system = spark.createDataFrame(rows, "cid int, a bigint, b bigint, " + ", ".join(f"{c} double" for c in [*relocate.BLOCK, "r0", "r1", "r2"]))
    got = relocate.solve_clusters(system, 0.0).toPandas().iloc[0]
    m = np.array(rows[0][3:12]).reshape(3, 3)
    np.testing.assert_allclose([got.d_lon, got.d_lat, got.d_dep], np.linalg.solve(m, rows[0][12:]), rtol=1e-9)
    assert got.converged and got.v_lon <= np.linalg.inv(m)[0, 0] + 1e-12


def test_select_td_covers_every_event(spark):
    rng = np.random.default_rng(2)
    rows = [(1, int(i), int(i) + 1, 0, 1, 0.0, float(i), float(r)) for i, r in enumerate(rng.uniform(0, 1, 60))]
    rows += [(2, 100, 101, 0, 1, 0.0, 1.0, None)]
    td = spark.createDataFrame(rows, "cid int, eve0 bigint, eve1 bigint, stn_k int, stn_l int, td double, dist_km double, residual double")
    got = relocate.select_td(td, 10)
    assert got.where("cid = 2").count() == 1
    one = got.where("cid = 1").toPandas()
    assert 10 <= len(one) < 60 and set(one.eve0) | set(one.eve1) == set(range(61))
    assert got.exceptAll(td).count() == 0 and got.exceptAll(relocate.select_td(td.repartition(5), 10)).count() == 0
    assert relocate.select_td(td, None).count() == 61


def test_stage_lists_need_equal_length(spark):
    with pytest.raises(ValueError):
        relocate.relocate(None, None, None, MODEL, iterations=(1,), dist_km=(1.0, 2.0), damping=(0.0,))


def test_steps_in_one_task_are_those_of_all(spark, two_sizes, monkeypatch):
    """A cluster that one task solves gets what the steps over all tasks give, and both kinds may come together."""
    small = two_sizes.where("cid = 1")
    zero = spark.createDataFrame([(1, True), (2, True)], "cid int, zero_sum boolean")
    own = relocate.solve_clusters(small, 1.0, zero).toPandas().sort_values("event_id")
    monkeypatch.setattr(relocate, "LOCAL_BLOCKS", 0)
    far = relocate.solve_clusters(small, 1.0, zero).toPandas().sort_values("event_id")
    np.testing.assert_allclose(own.filter(like="_l").to_numpy(), far.filter(like="_l").to_numpy(), rtol=1e-3, atol=1e-6)
    assert own.converged.all() and far.converged.all() and len(own) == len(far) == 12


def test_registered_queries_do_the_whole_job(spark, tmp_path, monkeypatch):
    """relocate gets all stages and steps and every pair of a cluster; triple_differences too."""
    from shakegrid import registry

    rows = "cast(id as bigint)"
    spark.range(40).selectExpr(f"{rows} + 1 o_orderkey", f"{rows} * 40 + 7 o_custkey", "'O' o_orderstatus", "timestamp_ntz'2000-01-01 00:00:00' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr(
        f"{rows} + 1 l_orderkey", "3L l_partkey", "1L l_suppkey", "1 l_linenumber", "10.0D l_quantity", "1.0D l_extendedprice", "0.05D l_discount", "id * 0.001D l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(25).selectExpr(f"{rows} n_nationkey", "concat('S', id) n_name").write.parquet(f"{tmp_path}/nation.parquet")
    td = registry.triple_differences(spark, str(tmp_path))
    kept = [i for i in range(1, 41) if i % 20 != 7 and i % 97]
    ref = sum(i % 20 == 3 for i in kept)
    assert td.count() == len(kept) * (len(kept) - 1) // 2 - ref * (ref - 1) // 2 and td.where("dist_km >= 1").count() > 0
    seen = {}
    monkeypatch.setattr(registry.relocate_plan, "relocate", lambda cat, td, st, model, **kw: seen.update(kw, n=td.count()) or cat)
    registry.relocate(spark, str(tmp_path))
    assert not {"iterations", "dist_km", "damping", "max_td"} & set(seen) and seen["n"] == td.count()
