"""S travel times: straight rays, and first arrivals of a layered model tabulated by ray families."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geo import DEG_KM, with_geodesic, with_haversine
from ..functions.measure import settle
from ..session import cut, small

MAX_SAMPLES = 2_000
# Range where times must lie between d/10 and d/2 + 80 s, else a straight ray is taken.
NEAR_KM, NEAR_FAST, NEAR_SLOW, NEAR_SLACK = 120.0, 10.0, 2.0, 80.0


def layer_samples(layers: DataFrame) -> list[tuple[float, float]]:
    """(depth, Vs) of one model. A model is a short table by nature; a long one is an error."""
    rows = layers.orderBy("depth_km").select("depth_km", "vs").take(MAX_SAMPLES + 1)
    if not 1 <= len(rows) <= MAX_SAMPLES:
        raise ValueError(f"a velocity model has 1 to {MAX_SAMPLES} samples")
    return [(r.depth_km, r.vs) for r in rows]


def _search(edges: list[float], values: list[Column], x: Column) -> Column:
    """values[i] for edges[i-1] <= x < edges[i], as a balanced tree of conditions."""
    if len(values) == 1:
        return values[0]
    m = len(values) // 2
    return F.when(x < edges[m - 1], _search(edges[: m - 1], values[:m], x)).otherwise(
        _search(edges[m:], values[m:], x)
    )


class StraightModel:
    """hypot(distance, depth difference) / Vs(mid depth), Vs at least 0.5 km/s."""

    def __init__(self, samples: list[tuple[float, float]]):
        self.samples = samples

    @classmethod
    def constant(cls, vs: float) -> StraightModel:
        return cls([(0.0, vs)])

    def vs_at(self, depth: Column) -> tuple[Column, Column]:
        """(Vs, dVs/ddepth)."""
        s = self.samples
        if len(s) == 1:
            return F.lit(max(0.5, s[0][1])), F.lit(0.0)
        edges = [d for d, _ in s]
        value, slope = [F.lit(s[0][1])], [F.lit(0.0)]
        for (d0, v0), (d1, v1) in zip(s, s[1:]):
            g = (v1 - v0) / max(d1 - d0, 1e-9)
            value.append(F.lit(v0) + (depth - d0) * g)
            slope.append(F.lit(g))
        value.append(F.lit(s[-1][1]))
        slope.append(F.lit(0.0))
        v = _search(edges, value, depth)
        return F.greatest(v, F.lit(0.5)), F.when(v > 0.5, _search(edges, slope, depth)).otherwise(0.0)

    def add_times(self, df: DataFrame, dist: str, depth: str, stn_dep: str, out: str, slopes: bool = True) -> DataFrame:
        """Add ``{out}_t`` and, if asked, its slopes in distance and depth ``{out}_px``, ``{out}_pz``."""
        if len(self.samples) == 1:
            v, g = self.vs_at(F.lit(0.0))
        else:
            mid = F.greatest((F.col(depth) + F.col(stn_dep)) / 2, F.lit(0.0))
            df = df.withColumn("_mid", mid)
            v, g = self.vs_at(F.col("_mid"))
            df = df.withColumns({"_v": v, "_vg": g})
            v, g = F.col("_v"), F.col("_vg")
        dz = F.col(depth) - F.col(stn_dep)
        df = df.withColumn("_path", F.sqrt(F.col(dist) * F.col(dist) + dz * dz))
        path = F.col("_path")
        new = {f"{out}_t": path / v}
        if slopes:
            safe = F.greatest(path, F.lit(1e-9))
            new[f"{out}_px"] = F.col(dist) / safe / v
            new[f"{out}_pz"] = dz / safe / v - path / (v * v) * g / 2
        return df.withColumns(new).drop("_path", "_mid", "_v", "_vg")


CORNERS = [f"t{k}{i}{j}" for k in (0, 1) for i in (0, 1) for j in (0, 1)]


class GridModel:
    """Look-up in the table of ``travel_time_grid``, linear in station depth, distance and depth.

    The upper edges belong to the table. Beyond it, and where no ray arrives, the time is that of the straight ray in
    ``layers`` and ``{out}_straight`` is true; without ``layers`` it is null there.
    """

    def __init__(self, grid: DataFrame, layers: DataFrame | None = None):
        first = grid.select("dx", "dz", "ds").first()
        end = grid.agg(F.max("dist_cell"), F.max("dep_cell"), F.max("stn_cell")).first()
        self.grid, self.steps, self.last = grid, tuple(first), tuple(end)
        self.straight = StraightModel(layer_samples(layers)) if layers is not None else None

    def add_times(self, df: DataFrame, dist: str, depth: str, stn_dep: str, out: str, slopes: bool = True) -> DataFrame:
        keys = ("dist_cell", "dep_cell", "stn_cell")
        cells = self.grid.select(*keys, *CORNERS)
        at = [F.col(dist), F.greatest(F.col(depth), F.lit(0.0)), F.greatest(F.col(stn_dep), F.lit(0.0))]
        # A value on the upper edge belongs to the last cell.
        place = {k: F.when(x == (n + 1) * w, n).otherwise(F.floor(x / w)).cast("int") for k, x, w, n in zip(keys, at, self.steps, self.last)}
        df = df.withColumns(place)
        # The table does not grow with the catalogue; its size is checked all the same.
        df = df.join(small(cells, 2_000_000), list(keys), "left")
        u, w, h = (x / step - F.col(k) for k, x, step in zip(keys, at, self.steps))
        mix = lambda f, lo, hi: lo + f * (hi - lo)
        c = {(i, j): mix(h, F.col(f"t0{i}{j}"), F.col(f"t1{i}{j}")) for i in (0, 1) for j in (0, 1)}
        near, far = mix(u, c[0, 0], c[1, 0]), mix(u, c[0, 1], c[1, 1])
        new = {f"{out}_t": mix(w, near, far)}
        if slopes:
            new[f"{out}_px"] = mix(w, c[1, 0] - c[0, 0], c[1, 1] - c[0, 1]) / self.steps[0]
            new[f"{out}_pz"] = (far - near) / self.steps[1]
        df = df.withColumns(new).drop(*keys, *CORNERS)
        if self.straight is None:
            return df
        df = self.straight.add_times(df, dist, depth, stn_dep, "_line", slopes)
        missing = F.col(f"{out}_t").isNull()
        df = df.withColumns({f"{out}_straight": missing, **{f"{out}_{x}": F.when(missing, F.col(f"_line_{x}")).otherwise(F.col(f"{out}_{x}")) for x in ("t", "px", "pz")[: 3 if slopes else 1]}})
        return df.drop("_line_t", "_line_px", "_line_pz")


def extent(events: DataFrame, stations: DataFrame, hyp_bottom: float = 100.0, margin_km: float = 150.0) -> tuple[float, float, float]:
    """(distance, depth, station depth) in km that hold every event at every station, with room for a search.

    The distance is a bound from the boxes around both; the table it asks for does not grow with the number of rows.
    """
    box = [d.agg(*(f(c) for c in ("lat", "lon") for f in (F.min, F.max))).first() for d in (events, stations)]
    if None in (*box[0], *box[1]):
        return margin_km, hyp_bottom, 0.0
    lat, lon = (max(b[k + 1] for b in box) - min(b[k] for b in box) for k in (0, 2))
    across = min(lon, 360.0 - lon) if lon > 180 else lon
    depth = events.agg(F.max("depth_km")).first()[0]
    deepest = stations.agg(F.max("dep_km")).first()[0]
    return min(math.hypot(lat, across) * DEG_KM + margin_km, 20_040.0), max(hyp_bottom, depth or 0.0), max(deepest or 0.0, 0.0)


def grid_model(layers: DataFrame, events: DataFrame, stations: DataFrame, hyp_bottom: float = 100.0, steps: tuple[float, float, float] = (2.0, 1.0, 0.5), **kw) -> GridModel:
    """The layered model tabulated for these events and stations (X02, X03), written once."""
    ends = extent(events, stations, hyp_bottom)
    sides = [(max(1, math.ceil(end / step - 1e-9)) * step, step) for end, step in zip(ends, steps)]
    return GridModel(cut(travel_time_grid(layers, *sides, **kw)), layers)


def travel_times(pairs: DataFrame, model) -> DataFrame:
    """(event, station) rows with ``dist_km, depth_km, stn_dep, sc`` -> ``tt`` with the station term."""
    out = model.add_times(pairs, "dist_km", "depth_km", "stn_dep", "_s", slopes=False)
    return out.withColumn("tt", F.col("_s_t") + F.col("sc")).drop("_s_t", "_s_straight")


def partials(pairs: DataFrame, model) -> DataFrame:
    """(event_id, stn_idx, g_lon, g_lat, g_dep, tt) from ``event_station`` rows."""
    out = model.add_times(pairs, "dist_km", "depth_km", "stn_dep", "_s")
    g = place_slopes("_s_px", "_s_pz", "azimuth", "lat")
    return out.select(
        "event_id", "stn_idx", *[c.alias(k) for k, c in g.items()], (F.col("_s_t") + F.col("sc")).alias("tt")
    )


def place_slopes(px: str, pz: str, azimuth: str, lat: str) -> dict[str, Column]:
    """Slopes in distance and depth -> dt/dlon, dt/dlat [s/deg], dt/ddep [s/km]."""
    az = F.radians(azimuth)
    return {
        "g_lon": -F.col(px) * F.sin(az) * DEG_KM * F.cos(F.radians(lat)),
        "g_lat": -F.col(px) * F.cos(az) * DEG_KM,
        "g_dep": F.col(pz),
    }


def add_lag_times(df: DataFrame, model, wgs84: bool = True, slopes: bool = True) -> DataFrame:
    """Predicted lag ``calc`` = t_l - t_k and its slopes ``g_lon, g_lat, g_dep``.

    Rows carry the hypocenter (lat, lon, depth_km) and both stations (k_lat, k_lon, k_dep, k_sc, l_..).
    """
    measure = with_geodesic if wgs84 else with_haversine
    for end in ("k", "l"):
        df = measure(df, "lat", "lon", f"{end}_lat", f"{end}_lon", f"_{end}_d", f"_{end}_az" if slopes else None)
        df = model.add_times(df, f"_{end}_d", "depth_km", f"{end}_dep", f"_{end}", slopes)
        if slopes:
            g = place_slopes(f"_{end}_px", f"_{end}_pz", f"_{end}_az", "lat")
            df = df.withColumns({f"_{end}_{k}": c for k, c in g.items()})
    new = {"calc": (F.col("_l_t") + F.col("l_sc")) - (F.col("_k_t") + F.col("k_sc"))}
    if slopes:
        new.update({g: F.col(f"_l_{g}") - F.col(f"_k_{g}") for g in ("g_lon", "g_lat", "g_dep")})
    extra = [f"_{e}_{x}" for e in "kl" for x in ("d", "az", "t", "px", "pz", "straight", "g_lon", "g_lat", "g_dep")]
    return settle(df, new).drop(*extra)


# ---- layered model ---------------------------------------------------------------------------
# Along a ray of parameter p a layer of constant gradient adds closed-form distance and time. For
# each source depth the rays are sampled in families: upgoing rays, and the rays that turn in one
# given layer. Summing the layers of every ray gives points of the travel-time curve; the table
# takes, at each distance, the earliest time of the curve pieces that span it.


def _steps(end: float, step: float) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(int(math.floor(end / step + 1e-9)))))


def travel_time_grid(
    layers: DataFrame, dist: tuple[float, float] = (200.0, 2.0), depth: tuple[float, float] = (100.0, 1.0),
    stn_depth: tuple[float, float] = (3.0, 0.5), rays: int = 64, up_rays: int = 600,
) -> DataFrame:
    """First-arrival table of one model (X02): cells with the times at their eight corners.

    ``dist``, ``depth`` and ``stn_depth`` are (end, step); one cell at least in each direction. Times beyond the
    reach of any ray are straight-ray times up to 120 km and null beyond.
    """
    stn_depth = (max(stn_depth), stn_depth[1])
    spark = layers.sparkSession
    samples = layer_samples(layers)
    straight = StraightModel(samples)
    # Thin steps with the depth order of the model, extended a little below the last sample.
    pieces = [
        (i, d0, d1, v0, v1) for i, ((d0, v0), (d1, v1)) in enumerate(zip(samples, samples[1:])) if d1 > d0
    ]
    layer = spark.createDataFrame(pieces, "layer int, z0 double, z1 double, v0 double, v1 double").repartition("layer")
    deepest = samples[-1][0]
    one = spark.range(1)
    source = one.select(_steps(depth[0], depth[1]).alias("src"))
    source = source.withColumn("zs", F.least(F.col("src") * depth[1], F.lit(deepest - 1e-6)))
    source = source.withColumn("vs", straight_value(samples, F.col("zs")))
    both = source.withColumn("stn_bin", _steps(stn_depth[0], stn_depth[1]))
    both = both.withColumn("zr", F.least(F.col("stn_bin") * stn_depth[1], F.lit(deepest - 1e-6)))
    both = both.withColumns({"top": F.least("zs", "zr"), "foot": F.greatest("zs", "zr")})
    # One row per layer and depth pair: every layer meets every depth through its number.
    numbered = F.explode(F.array(*[F.lit(i) for i, *_ in pieces])).alias("layer")
    met = both.select("*", numbered).join(small(layer), "layer")
    cut_v = lambda z: F.col("v0") + (z - F.col("z0")) * (F.col("v1") - F.col("v0")) / (F.col("z1") - F.col("z0"))
    a, b = F.greatest("z0", "top"), F.least("z1", "foot")
    between = met.where(b > a).select(
        "src", "stn_bin", "layer", cut_v(a).alias("va"), cut_v(b).alias("vb"), (b - a).alias("h"), F.lit(1.0).alias("times"),
    )
    c = F.greatest("z0", "foot")
    below = met.where(F.col("z1") > c).select(
        "src", "stn_bin", "layer", cut_v(c).alias("va"), F.col("v1").alias("vb"), (F.col("z1") - c).alias("h"), F.lit(2.0).alias("times"),
    )
    # Fastest velocity above each turning layer: at the ends, between them, and in the layers passed.
    inside = between.groupBy("src", "stn_bin").agg(F.max(F.greatest("va", "vb")).alias("vmax"))
    ends = both.select("src", "stn_bin", "vs", straight_value(samples, F.col("zr")).alias("vr"), "zs", "zr", "top", "foot")
    ends = ends.join(inside, ["src", "stn_bin"], "left").withColumn("vmax", F.greatest("vs", "vr", F.coalesce("vmax", F.lit(0.0))))
    w = Window.partitionBy("src", "stn_bin").orderBy("layer")
    passed = F.max("vb").over(w.rowsBetween(Window.unboundedPreceding, -1))
    turning = (
        below.join(ends.select("src", "stn_bin", "vmax"), ["src", "stn_bin"])
        .withColumn("before", F.greatest("va", "vmax", F.coalesce(passed, F.lit(0.0))))
        .where(F.col("vb") > F.col("before") * (1 + 1e-9))
    )
    u = F.col("k") / F.lit(float(rays))
    families = turning.select(
        "src", "stn_bin", F.col("layer").alias("family"), F.explode(F.sequence(F.lit(0), F.lit(rays))).alias("k"), "before", "vb",
    ).select(
        "src", "stn_bin", "family", "k",
        (1 / F.col("vb") + (1 / F.col("before") - 1 / F.col("vb")) * (1 - F.cos(u * math.pi)) / 2).alias("p"),
    )
    grazing = 1 - F.pow(1 - F.col("k") / F.lit(float(up_rays)), 3)
    up = ends.select("src", "stn_bin", F.lit(-1).alias("family"), "vmax", F.explode(F.sequence(F.lit(0), F.lit(up_rays))).alias("k"))
    up = up.select("src", "stn_bin", "family", "k", (F.sin(grazing * math.pi / 2) / F.col("vmax")).alias("p"))
    ray = families.unionByName(up)

    legs = between.unionByName(below)
    on = ray.join(legs, ["src", "stn_bin"]).where(
        (F.col("times") == 1) | ((F.col("family") >= 0) & (F.col("layer") <= F.col("family")))
    )
    cosine = lambda v: F.sqrt(F.greatest(1 - F.col("p") * F.col("p") * v * v, F.lit(0.0)))
    turn = (F.col("layer") == F.col("family")) & (F.col("times") == 2)
    on = on.withColumn("vz", F.when(turn, F.least(F.col("vb"), 1 / F.greatest(F.col("p"), F.lit(1e-12)))).otherwise(F.col("vb")))
    on = on.withColumns(
        {"ca": cosine(F.col("va")), "cb": F.when(turn, 0.0).otherwise(cosine(F.col("vb"))), "g": (F.col("vb") - F.col("va")) / F.col("h")}
    )
    flat = F.abs("g") < 1e-7
    mean_v = (F.col("va") + F.col("vb")) / 2
    mean_c = F.greatest((F.col("ca") + F.col("cb")) / 2, F.lit(1e-9))
    # (ca - cb)/(p g) written without the small difference of the cosines.
    x = F.when(flat, F.col("h") * F.col("p") * mean_v / mean_c).otherwise(
        F.col("p") * (F.col("vz") * F.col("vz") - F.col("va") * F.col("va")) / (F.col("g") * F.greatest(F.col("ca") + F.col("cb"), F.lit(1e-12)))
    )
    t = F.when(flat, F.col("h") / (mean_v * mean_c)).otherwise(
        F.log(F.col("vz") * (1 + F.col("ca")) / (F.col("va") * (1 + F.col("cb")))) / F.col("g")
    )
    curve = (
        on.groupBy("src", "stn_bin", "family", "k")
        .agg(F.sum(x * F.col("times")).alias("x"), F.sum(t * F.col("times")).alias("t"), F.max("p").alias("p"))
    )
    step = Window.partitionBy("src", "stn_bin", "family").orderBy("k")
    nxt = {c: F.lead(c).over(step) for c in ("x", "t", "p")}
    piece = curve.withColumns({f"{c}2": e for c, e in nxt.items()}).where(F.col("x2").isNotNull())
    piece = piece.withColumns({"lo": F.least("x", "x2"), "hi": F.greatest("x", "x2")})
    dx, last = dist[1], int(math.floor(dist[0] / dist[1] + 1e-9))
    first_node = F.least(F.ceil(F.col("lo") / dx - 1e-9), F.lit(last + 1)).cast("int")
    last_node = F.least(F.floor(F.col("hi") / dx + 1e-9), F.lit(last)).cast("int")
    node = piece.where(first_node <= last_node).select("*", F.explode(F.sequence(first_node, last_node)).alias("node"))
    part = F.when(F.col("x2") != F.col("x"), (F.col("node") * dx - F.col("x")) / (F.col("x2") - F.col("x"))).otherwise(0.0)
    # dt/dx = p along the curve, p taken as linear between two rays.
    p_here = F.col("p") + part * (F.col("p2") - F.col("p"))
    time = F.col("t") + (F.col("p") + p_here) / 2 * (F.col("node") * dx - F.col("x"))
    x_here = F.col("node") * F.lit(dx)
    ok = (x_here > NEAR_KM) | ((time >= x_here / NEAR_FAST) & (time <= x_here / NEAR_SLOW + NEAR_SLACK))
    times = node.groupBy("src", "stn_bin", "node").agg(F.min(F.when(ok, time)).alias("t_ok"), F.min(time).alias("t_any"))
    nodes = ends.select("src", "stn_bin", "zs", "zr", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("node"))
    nodes = nodes.join(times, ["src", "stn_bin", "node"], "left").withColumn("x", F.col("node") * F.lit(dx))
    nodes = straight.add_times(nodes, "x", "zs", "zr", "_line", slopes=False)
    nodes = nodes.select(
        "stn_bin", "node", "src",
        # At equal depths the level path is one of the rays, and none of the families has it.
        F.least(F.coalesce("t_ok", "t_any", F.when(F.col("x") <= NEAR_KM, F.col("_line_t"))), F.when(F.col("zs") == F.col("zr"), F.col("_line_t"))).alias("t"),
    )
    # Eight corners on one row: each node is a corner of up to eight cells.
    corners = nodes.select(
        F.explode(F.array(*[
            F.struct((F.col("stn_bin") - k).alias("stn_cell"), (F.col("node") - i).alias("dist_cell"), (F.col("src") - j).alias("dep_cell"), F.lit(f"t{k}{i}{j}").alias("corner"))
            for k in (0, 1) for i in (0, 1) for j in (0, 1)
        ])).alias("c"), "t",
    )
    cell = corners.groupBy("c.stn_cell", "c.dist_cell", "c.dep_cell").agg(
        *[F.max(F.when(F.col("c.corner") == n, F.col("t"))).alias(n) for n in CORNERS], F.count("*").alias("_n")
    )
    return cell.where(F.col("_n") == 8).drop("_n").withColumns(
        {"dx": F.lit(dist[1]), "dz": F.lit(depth[1]), "ds": F.lit(stn_depth[1])}
    )


def straight_value(samples: list[tuple[float, float]], depth: Column) -> Column:
    """Vs of the model at a depth, at least 0.01."""
    model = StraightModel(samples)
    s = model.samples
    value = [F.lit(s[0][1])] + [
        F.lit(v0) + (depth - d0) * ((v1 - v0) / max(d1 - d0, 1e-9)) for (d0, v0), (d1, v1) in zip(s, s[1:])
    ] + [F.lit(s[-1][1])]
    return F.greatest(_search([d for d, _ in s], value, depth), F.lit(0.01))
