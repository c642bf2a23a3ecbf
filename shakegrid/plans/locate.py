"""Locating many events at once from their lags.

Every solver is a loop of passes over all lag rows: join the trial places, predict the lags in
generated code, and sum per event. Lag rows are laid out once by (event, chunk); a chunk holds at
most CHUNK rows, so an event with very many lags is summed by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import DEG_KM
from ..functions.measure import clamp_depth, residual_weight
from ..operators.stats import best_candidate
from ..session import bucketed, cut, small, width
from .traveltime import add_lag_times

CHUNK = 4_096
#: Places of all its events that a task sums at once, and the most parts that lags are cut into for it (a bucketed table has 100,000 at most).
PLACES = 500_000
MOST_PARTS = 50_000
HYP_BOTTOM = 100.0
PLACE = ("lat", "lon", "depth_km")


def observations(lags: DataFrame, stations: DataFrame) -> DataFrame:
    """Lag rows with the places of both stations, partitioned by (event_id, chunk) and written once."""
    st = small(stations.select("stn_idx", "lat", "lon", "dep_km", "sc"))
    out = lags.select("event_id", "seq", "stn_k", "stn_l", "lag", "weight")
    for end in ("k", "l"):
        named = {"lat": f"{end}_lat", "lon": f"{end}_lon", "dep_km": f"{end}_dep", "sc": f"{end}_sc", "stn_idx": f"stn_{end}"}
        out = out.join(st.select(*[F.col(a).alias(b) for a, b in named.items()]), f"stn_{end}")
    out = out.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    return bucketed(out, width(out), "event_id", "chunk")


def _chunks(obs: DataFrame) -> DataFrame:
    return obs.groupBy("event_id").agg((F.max("chunk") + 1).alias("n_chunk"))


def _meet(obs: DataFrame, state: DataFrame) -> DataFrame:
    """Lag rows of the events in ``state`` next to the event's row."""
    each = state.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunk") - 1)))
    # A packed table is sized far below its rows; sent whole, its lags would leave their buckets.
    return obs.hint("merge").join(each.drop("n_chunk"), ["event_id", "chunk"])


def uniform(seed: int, *key) -> Column:
    """Reproducible number in [0, 1) from a hash of the key."""
    h = F.xxhash64(F.lit(seed), *key)
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def residual_table(obs: DataFrame, events: DataFrame, model, wgs84: bool = True) -> DataFrame:
    """Calculated lag, residual O-C and weight of every lag row (X12); rows without a time drop."""
    state = events.select("event_id", *PLACE).join(_chunks(obs), "event_id")
    rows = add_lag_times(_meet(obs, state), model, wgs84, slopes=False).where(F.col("calc").isNotNull())
    return rows.withColumn("residual", F.col("lag") - F.col("calc")).select(
        "event_id", "seq", "stn_k", "stn_l", "lag", "calc", "residual", residual_weight("residual").alias("weight")
    )


def misfit(residuals: DataFrame) -> DataFrame:
    """Spread of the residuals about their mean per event."""
    return residuals.groupBy("event_id").agg(F.count("*").alias("n"), F.stddev_pop("residual").alias("misfit"))


def rms(residuals: DataFrame) -> DataFrame:
    """Root mean square of the residuals that are not excluded, weight 0."""
    kept = residuals.where(F.col("weight") != 0)
    return kept.groupBy("event_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))


def log_likelihood(residuals: DataFrame, keys=("event_id",)) -> DataFrame:
    """Minus the sum of squares per event or candidate; minus infinity if a residual is missing."""
    bad = F.bool_or(F.col("residual").isNull() | F.isnan("residual"))
    total = -F.sum(F.col("residual") * F.col("residual"))
    return residuals.groupBy(*keys).agg(F.when(bad, float("-inf")).otherwise(total).alias("loglik"))


def _fine(obs: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """``obs`` in parts whose events have at most about PLACES of ``n`` places each, so that their sums stay in memory."""
    parts = -(-state.count() * n // PLACES)
    return obs if parts <= width(obs) else bucketed(obs, min(parts, MOST_PARTS), "event_id", "chunk")


def _by_size(state: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """(keys, events): events whose lags lie in one chunk, summed and compared where they lie, and events with more, if any."""
    many = state.where("n_chunk > 1")
    return [(["event_id", "chunk"], state.where("n_chunk = 1"))] + ([] if many.isEmpty() else [(["event_id"], many)])


def _candidate_rows(obs: DataFrame, state: DataFrame, place: dict[str, Column], n: int, model, wgs84: bool) -> DataFrame:
    """Residual of every lag row at each of ``n`` places per event; ``place`` may use ``ord`` 1..n."""
    rows = _meet(obs, state).withColumn("ord", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = add_lag_times(rows.withColumns(place), model, wgs84, slopes=False)
    return rows.withColumn("residual", F.col("lag") - F.col("calc"))


def locate_search(
    events: DataFrame, obs: DataFrame, model, *, bottom: float | Column = 0.01, stages: int = 3, n: int = 300,
    seed: int = 0, hyp_bottom: float = HYP_BOTTOM, wgs84: bool = True, trace: list | None = None,
) -> DataFrame:
    """Random search in shrinking boxes around the best place so far.

    Stage f tries its share of the n points within +-1 degree and +-10 km times 0.5**f; the best one replaces
    the place if it is strictly better. A place at which a lag has no time never wins. Result: place, ``rms`` =
    misfit, errors 0, mode GRD; ``n_used`` and ``n_lost`` count the lags with and without a time there. An event
    without lags, or without a place at which all have times, keeps its place with mode ERR.
    ``trace`` collects one (event_id, step, evaluations, residual) DataFrame per stage.
    """
    top = F.lit(bottom) if not isinstance(bottom, Column) else bottom
    state = events.select("event_id", *PLACE).join(_chunks(obs), "event_id")
    first = _at_place(obs, state, model, wgs84).groupBy("event_id").agg(
        F.when(F.count("residual") == F.count("*"), F.stddev_pop("residual")).alias("misfit"), F.count("residual").alias("n_used"), F.count("*").alias("_rows")
    )
    state = cut(state.join(first, "event_id").withColumns({"top": top, "steps": F.lit(1)}))
    obs = _fine(obs, state, -(-n // stages))
    for f in range(stages):
        per = n // stages + (f < n % stages)
        half = 0.5**f

        def draw(c: str, lo: Column, hi: Column) -> Column:
            return lo + (hi - lo) * uniform(seed, F.lit(f), F.lit(c), F.col("event_id"), F.col("ord"))

        at = {
            "lat": draw("lat", F.col("lat") - half, F.col("lat") + half),
            "lon": draw("lon", F.col("lon") - half, F.col("lon") + half),
            "depth_km": draw(
                "depth", F.greatest(F.col("top"), F.col("depth_km") - 10 * half),
                F.least(F.lit(hyp_bottom), F.col("depth_km") + 10 * half),
            ),
        }
        scored = []
        for keys, own in _by_size(state):
            tried = _candidate_rows(obs, own, at, per, model, wgs84)
            # The place follows from (event, ord); it is carried by max() of equal values.
            each = tried.groupBy(*keys, "ord").agg(
                F.stddev_pop("residual").alias("misfit"), F.count("residual").alias("_ok"), F.count("*").alias("_n"),
                *[F.max(c).alias(c) for c in PLACE],
            )
            each = each.withColumn("misfit", F.when(F.col("_ok") == F.col("_n"), F.col("misfit")))
            scored.append(best_candidate(each, keys).select("event_id", "ord", "misfit", *PLACE))
        here = state.select("event_id", F.lit(0).alias("ord"), "misfit", *PLACE)
        best = best_candidate(reduce(DataFrame.unionByName, scored, here)).select("event_id", F.when(F.col("misfit") < float("inf"), F.col("misfit")).alias("misfit"), *PLACE)
        state = state.drop("misfit", *PLACE).join(best, "event_id").withColumn("steps", F.col("steps") + per)
        state = cut(state.withColumn("n_used", F.when(F.col("misfit").isNotNull(), F.col("_rows")).otherwise(F.col("n_used"))))
        if trace is not None:
            trace.append(state.select("event_id", F.lit(f).alias("step"), F.col("steps").alias("evaluations"), F.col("misfit").alias("residual")))
    found = state.select(
        "event_id", *PLACE, *[F.lit(0.0).alias(c) for c in ("err_lat_km", "err_lon_km", "err_dep_km")],
        F.col("misfit").alias("rms"), F.when(F.col("misfit").isNull(), "ERR").otherwise("GRD").alias("mode"), F.col("steps").alias("evaluations"),
        "n_used", (F.col("_rows") - F.col("n_used")).alias("n_lost"),
    )
    return _with_the_rest(found, events)


def _with_the_rest(found: DataFrame, events: DataFrame) -> DataFrame:
    """``found`` and the events that it lacks, at their place with mode ERR and counts of 0."""
    zero = ("err_lat_km", "err_lon_km", "err_dep_km", "evaluations", "n_used", "n_lost", "n_samples")
    rest = events.join(found.select("event_id"), "event_id", "left_anti")
    value = lambda c, t: F.lit("ERR") if c == "mode" else F.lit(0) if c in zero else F.lit(False) if t == "boolean" else F.lit(None)
    rest = rest.select(*[F.col(c) if c in ("event_id", *PLACE) else value(c, t).cast(t).alias(c) for c, t in found.dtypes])
    return found.unionByName(rest)


def _at_place(obs: DataFrame, state: DataFrame, model, wgs84: bool) -> DataFrame:
    rows = add_lag_times(_meet(obs, state), model, wgs84, slopes=False)
    return rows.withColumn("residual", F.col("lag") - F.col("calc"))


# ---- least squares ---------------------------------------------------------------------------

_AXES = ("lon", "lat", "dep")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_A = [f"a{i}{j}" for i, j in _PAIRS]
_B = [f"b{i}" for i in range(3)]


def normal_sums(residual: str = "residual", weight: str | None = None) -> list[Column]:
    """Sums of the 3x3 normal equations, right side, cost and count over lag rows."""
    g = [F.col(f"g_{x}") for x in _AXES]
    w = F.col(weight) if weight else F.lit(1.0)
    r = F.col(residual)
    return (
        [F.sum(w * g[i] * g[j]).alias(f"a{i}{j}") for i, j in _PAIRS]
        + [F.sum(w * g[i] * r).alias(f"b{i}") for i in range(3)]
        + [F.sum(w * r * r).alias("cost"), F.count(r).alias("n")]
    )


def with_inverse3(df: DataFrame, a: dict[tuple[int, int], Column]) -> DataFrame:
    """Add the inverse ``_i00 .. _i22`` of a symmetric 3x3 matrix of Columns; null when singular."""
    df = df.withColumns({f"_m{i}{j}": c for (i, j), c in a.items()})
    m = lambda i, j: F.col(f"_m{min(i, j)}{max(i, j)}")

    def cofactor(i: int, j: int) -> Column:
        r, s = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        minor = m(r[0], s[0]) * m(r[1], s[1]) - m(r[0], s[1]) * m(r[1], s[0])
        return minor if (i + j) % 2 == 0 else -minor

    df = df.withColumns({f"_c{i}{j}": cofactor(i, j) for i, j in _PAIRS})
    df = df.withColumn("_det", m(0, 0) * F.col("_c00") + m(0, 1) * F.col("_c01") + m(0, 2) * F.col("_c02"))
    sound = F.abs("_det") > F.abs(m(0, 0) * m(1, 1) * m(2, 2)) * 1e-14
    df = df.withColumn("_det", F.when(sound, F.col("_det")))
    df = df.withColumns({f"_i{i}{j}": F.col(f"_c{i}{j}") / F.col("_det") for i, j in _PAIRS})
    return df.drop("_det", *[f"_{x}{i}{j}" for x in "mc" for i, j in _PAIRS])


def _repaired(depth: Column, top: Column, hyp_bottom: float, seed: int, step: int) -> Column:
    """Depth above the shallowest allowed: random; below the deepest: 0.9 of it."""
    return F.when(depth <= top, F.greatest(uniform(seed, F.lit(step), F.col("event_id")) * hyp_bottom, top)).when(
        depth > hyp_bottom, 0.9 * hyp_bottom
    ).otherwise(depth)


def locate_lsq(
    events: DataFrame, obs: DataFrame, model, *, bottom: float | Column = 0.01, hyp_bottom: float = HYP_BOTTOM,
    max_iter: int = 100, rounds: int = 10, tol: float = 1e-8, seed: int = 0, wgs84: bool = True,
    trace: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Damped least squares with outlier rounds (X06): (events, lag rows with ``weight``).

    All events step together, one pass over their lags per iteration, each with its own damping.
    After convergence lag rows beyond twice the rms leave and the event starts again, at most
    ``rounds`` times. Settled events leave the passes. Errors come from rms^2 (J'J)^-1, 999 when
    singular; weights are 1/|residual|, 0 for rows left out. Lags of weight 0 never take part. A step at which fewer
    lags have a time is never taken. ``n_used`` and ``n_lost`` count the lags that took part with and without a time at
    the place found; ``converged`` tells whether the last steps ended by themselves. Events without lags keep their place
    with mode ERR.
    """
    top = F.lit(bottom) if not isinstance(bottom, Column) else bottom
    infinity = F.lit(float("inf"))
    fresh = {"cost": infinity, "lam": F.lit(1e-3), "n": F.lit(0).cast("bigint"), "moving": F.lit(True),
             **{c: F.lit(0.0) for c in _A + _B}, **{f"x_{c}": F.col(c) for c in PLACE}}
    obs = obs.withColumn("ok", F.col("weight") != 0)
    state = events.select("event_id", *PLACE).join(_chunks(obs), "event_id")
    state = state.withColumns({"top": top, "open": F.lit(True), "round": F.lit(0), "steps": F.lit(0), "converged": F.lit(False)})
    step_no = 0
    for turn in range(rounds):
        state = cut(state.withColumns({k: F.when(F.col("open"), v).otherwise(F.col(k)) if k in state.columns else v for k, v in fresh.items()}).withColumn("moving", F.col("open")))
        for _ in range(max_iter):
            step_no += 1
            # PLACE holds the trial place, x_ the best place so far with its sums.
            moving = state.where("moving").select("event_id", "n_chunk", *PLACE)
            rows = add_lag_times(_meet(obs.where("ok"), moving), model, wgs84)
            rows = rows.where(F.col("calc").isNotNull()).withColumn("residual", F.col("lag") - F.col("calc"))
            sums = rows.groupBy("event_id").agg(*normal_sums())
            sums = sums.select("event_id", *[F.col(c).alias(f"_{c}") for c in _A + _B + ["cost", "n"]])
            new = state.where("moving").join(sums, "event_id", "left")
            mean = lambda cost, n: F.col(cost) / F.greatest(F.col(n), F.lit(1))
            better = F.coalesce((F.col("_n") >= F.col("n")) & (mean("_cost", "_n") < mean("cost", "n")), F.lit(False))
            gain = (mean("cost", "n") - mean("_cost", "_n")) <= tol * mean("cost", "n")
            new = new.withColumns({"_better": better, "_small": better & F.coalesce(gain, F.lit(False)) & (F.col("cost") < infinity)})
            take = lambda c, old: F.when(F.col("_better"), c).otherwise(old)
            new = new.withColumns(
                {
                    **{f"x_{c}": take(F.col(c), F.col(f"x_{c}")) for c in PLACE},
                    **{c: take(F.col(f"_{c}"), F.col(c)) for c in _A + _B + ["cost", "n"]},
                    "lam": F.when(F.col("_better"), F.col("lam") / 10).otherwise(F.col("lam") * 10),
                    "steps": F.col("steps") + 1,
                }
            )
            a = {(i, j): F.col(f"a{i}{j}") * (1 + F.col("lam") if i == j else 1.0) for i, j in _PAIRS}
            new = with_inverse3(new, a)
            move = [sum((F.col(f"_i{min(i, j)}{max(i, j)}") * F.col(f"b{j}") for j in (1, 2)), F.col(f"_i0{i}") * F.col("b0")) for i in range(3)]
            new = new.withColumns({f"_d{i}": F.coalesce(m, F.lit(0.0)) for i, m in enumerate(move)})
            tiny = (F.abs("_d0") < tol) & (F.abs("_d1") < tol) & (F.abs("_d2") < tol * 100)
            new = new.withColumns(
                {
                    "lon": F.col("x_lon") + F.col("_d0"), "lat": F.col("x_lat") + F.col("_d1"),
                    "depth_km": _repaired(F.col("x_depth_km") + F.col("_d2"), F.col("top"), hyp_bottom, seed, step_no),
                    "moving": ~(F.col("_small") | tiny | (F.col("lam") > 1e8) | (F.col("cost") == infinity)),
                }
            )
            rest = state.where(~F.col("moving"))
            state = cut(rest.unionByName(new.select(*rest.columns)))
            if trace is not None:
                trace.append(state.select("event_id", F.lit(step_no).alias("step"), F.col("steps").alias("evaluations"), F.sqrt(F.col("cost") / F.col("n")).alias("residual")))
            if state.where("moving").isEmpty():
                break
        state = state.withColumn("converged", F.when(F.col("open"), ~F.col("moving")).otherwise(F.col("converged")))
        # Rows beyond twice the rms leave; their events go on with the next round.
        seat = state.where("open").select("event_id", "n_chunk", *[F.col(f"x_{c}").alias(c) for c in PLACE], F.sqrt(F.col("cost") / F.col("n")).alias("_rms"))
        far = add_lag_times(_meet(obs.where("ok"), seat), model, wgs84, slopes=False)
        far = far.where(F.abs(F.col("lag") - F.col("calc")) > 2 * F.col("_rms")).select("event_id", "chunk", "seq")
        far = cut(far)
        hit = far.groupBy("event_id").agg(F.count("*").alias("_hits"))
        state = state.join(hit, "event_id", "left").withColumns(
            {
                "open": F.coalesce(F.col("_hits") > 0, F.lit(False)),
                "round": F.col("round") + F.col("open").cast("int"),
                **{c: F.col(f"x_{c}") for c in PLACE},
            }
        ).drop("_hits")
        state = cut(state)
        obs = obs.join(far.withColumn("_far", F.lit(True)), ["event_id", "chunk", "seq"], "left")
        obs = obs.withColumn("ok", F.col("ok") & F.col("_far").isNull()).drop("_far")
        if state.where("open").isEmpty():
            break
        obs = bucketed(obs, width(obs), "event_id", "chunk")
    part = obs.where("ok").groupBy("event_id").agg(F.count("*").alias("_rows"))
    out = with_inverse3(state.join(part, "event_id", "left"), {(i, j): F.col(f"a{i}{j}") for i, j in _PAIRS})
    var = F.col("cost") / F.col("n")
    out = out.withColumns({f"_s{i}": F.when(F.col(f"_i{i}{i}") >= 0, F.sqrt(var * F.col(f"_i{i}{i}"))) for i in range(3)})
    singular = F.col("_s0").isNull() | F.col("_s1").isNull() | F.col("_s2").isNull()
    sd = [F.when(singular, 999.0).otherwise(F.col(f"_s{i}")) for i in range(3)]
    placed = out.select(
        "event_id", *[F.col(f"x_{c}").alias(c) for c in PLACE],
        (sd[1] * DEG_KM).alias("err_lat_km"), (sd[0] * DEG_KM * F.cos(F.radians("x_lat"))).alias("err_lon_km"), sd[2].alias("err_dep_km"),
        F.sqrt(var).alias("rms"),
        F.when((F.col("x_depth_km") > hyp_bottom) | (F.col("cost") == infinity), "ERR").otherwise("LMO").alias("mode"),
        F.col("steps").alias("evaluations"), F.col("open").alias("rounds_exhausted"), F.col("n").alias("n_used"),
        F.greatest(F.coalesce("_rows", F.lit(0)) - F.col("n"), F.lit(0)).alias("n_lost"), "converged",
    )
    seat = out.select("event_id", "n_chunk", *[F.col(f"x_{c}").alias(c) for c in PLACE])
    used = add_lag_times(_meet(obs, seat), model, wgs84, slopes=False).withColumn("residual", F.col("lag") - F.col("calc"))
    used = used.select(
        "event_id", "seq", "stn_k", "stn_l", "lag", "calc", "residual",
        F.when(F.col("ok") & (F.col("residual") != 0), 1 / F.abs("residual")).when(F.col("ok"), 1e10).otherwise(0.0).alias("weight"),
    )
    return _with_the_rest(placed, events), used


def excluded_pairs(lags: DataFrame, stations: DataFrame) -> DataFrame:
    """(event_id, note): 'row:CODE-CODE' list of the dropped lag rows.

    The note of an event is one string by its nature; it holds only the dropped rows.
    """
    st = small(stations.select("stn_idx", "code"))
    rows = lags.where(F.col("weight") == 0)
    for end in ("k", "l"):
        rows = rows.join(st.select(F.col("stn_idx").alias(f"stn_{end}"), F.col("code").alias(f"c_{end}")), f"stn_{end}", "left")
    name = lambda end: F.coalesce(F.col(f"c_{end}"), F.concat(F.lit("?"), F.col(f"stn_{end}")))
    label = F.concat((F.col("seq") + 1).cast("string"), F.lit(":"), name("k"), F.lit("-"), name("l"))
    return rows.groupBy("event_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", label.alias("s")))), lambda x: x["s"]), ", ").alias("note")
    )


POSTERIOR = ["n_samples long", "ess double", "loglik double", *(f"{x}{c} double" for x in ("", "mean_", "sd_") for c in PLACE)]


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per event from the samples (event_id, ord, PLACE.., loglik, _lw) of a task, which has all of an event.

    Mean and spread come from the distances to the heaviest sample, which are small where the posterior is narrow. Of samples of
    equal weight or likelihood the first counts.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    events = rows.column("event_id").combine_chunks().dictionary_encode()
    event, order = events.indices.to_numpy(), rows.column("ord").to_numpy()
    place, loglik, lw = [rows.column(c).to_numpy() for c in PLACE], rows.column("loglik").to_numpy(), rows.column("_lw").to_numpy()
    at, best = np.lexsort((order, -lw, event)), np.lexsort((order, -loglik, event))
    lw, size = lw[at], np.bincount(event)
    first = np.cumsum(size) - size
    best = best[first]
    w = np.exp(lw - np.repeat(lw[first], size))
    total = np.add.reduceat(w, first)
    out = {"event_id": events.dictionary, "n_samples": size.astype(np.int64), "ess": total * total / np.add.reduceat(w * w, first), "loglik": loglik[best]}
    out.update({c: x[best] for c, x in zip(PLACE, place)})
    for c, x in zip(PLACE, place):
        x = x[at]
        away = x - np.repeat(x[first], size)
        shift = np.add.reduceat(w * away, first) / total
        out[f"mean_{c}"] = x[first] + shift
        out[f"sd_{c}"] = np.sqrt(np.maximum(np.add.reduceat(w * away * away, first) / total - shift * shift, 0.0))
    names = ["event_id", *(x.split()[0] for x in POSTERIOR)]
    yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)


def posterior(
    events: DataFrame, obs: DataFrame, model, *, n: int = 500, temperature: float = 1.0, bottom: float | Column = 0.01,
    hyp_bottom: float = HYP_BOTTOM, spread: tuple[float, float] = (0.1, 5.0), seed: int = 0, wgs84: bool = True,
) -> DataFrame:
    """Mean, spread and best place under exp(-sum r^2 / T) with depth bounds.

    Self-normalised importance sampling: ``n`` normal draws around each start place with standard
    deviations ``spread`` (degrees, km). ``ess`` is the effective number of samples; a small one
    marks events whose spread should be chosen anew. An event without a sample at which all its lags
    have times keeps its place with mode ERR.
    """
    top = F.lit(bottom) if not isinstance(bottom, Column) else bottom
    state = events.select("event_id", *PLACE).join(_chunks(obs), "event_id").withColumn("top", top)

    def z(axis: str) -> Column:
        key = (F.lit(axis), F.col("event_id"), F.col("ord"))
        u = F.greatest(uniform(seed, F.lit(1), *key), F.lit(1e-15))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, F.lit(2), *key))

    sd = {"lat": spread[0], "lon": spread[0], "depth_km": spread[1]}
    at = {f"_z_{c}": z(c) for c in PLACE}
    at.update({c: F.col(c) + sd[c] * z(c) for c in PLACE})
    obs = _fine(obs, state, n)
    draw = sum((F.col(f"_z_{c}") * F.col(f"_z_{c}") / 2 for c in PLACE[1:]), F.col(f"_z_{PLACE[0]}") * F.col(f"_z_{PLACE[0]}") / 2)
    inside = F.col("depth_km").between(F.col("top"), F.lit(hyp_bottom)) & (F.col("_ok") == F.col("_n"))
    log_weight = -F.col("_ss") / temperature + draw
    results = []
    for keys, own in _by_size(state):
        samples = _candidate_rows(obs, own, at, n, model, wgs84).groupBy(*keys, "ord").agg(
            F.sum(F.col("residual") * F.col("residual")).alias("_ss"), F.count("residual").alias("_ok"), F.count("*").alias("_n"),
            F.max("top").alias("top"), *[F.max(c).alias(c) for c in (*PLACE, *[f"_z_{c}" for c in PLACE])],
        )
        fits = samples.where(inside).select("event_id", "ord", *PLACE, (-F.col("_ss")).alias("loglik"), log_weight.alias("_lw"))
        if keys == ["event_id"]:
            fits = fits.repartition(width(fits), "event_id")
        results.append(fits.mapInArrow(weighed, ", ".join([f"event_id {dict(fits.dtypes)['event_id']}", *POSTERIOR])))
    found = reduce(DataFrame.unionByName, results).select(
        "event_id", *PLACE,
        (F.col("sd_lat") * DEG_KM).alias("err_lat_km"), (F.col("sd_lon") * DEG_KM * F.cos(F.radians("lat"))).alias("err_lon_km"),
        F.col("sd_depth_km").alias("err_dep_km"), "loglik", *[f"mean_{c}" for c in PLACE],
        "n_samples", "ess", F.lit("MCMC").alias("mode"),
    )
    return _with_the_rest(found, events)


def build_catalog(cat: DataFrame, located: DataFrame, job_mode: str) -> DataFrame:
    """Catalogue rows with the located places (X13); events not located keep their row, mode ERR.

    An empty mode becomes the mode of the job.
    """
    moved = ["lat", "lon", "depth_km", "err_lat_km", "err_lon_km", "err_dep_km", "rms"]
    new = located.select("event_id", *[F.col(c).alias(f"_{c}") for c in [*moved, "mode"]])
    mode = F.when(F.coalesce(F.col("_mode"), F.lit("ERR")) == "", job_mode).otherwise(F.coalesce("_mode", F.lit("ERR")))
    return cat.join(new, "event_id", "left").withColumns(
        {**{c: F.coalesce(f"_{c}", c) for c in moved}, "mode": mode}
    ).drop(*[f"_{c}" for c in [*moved, "mode"]])
