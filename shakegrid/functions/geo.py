"""Distances, cells and error shapes on the sphere and the WGS84 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .measure import col, finite, settle

RADIUS_KM = 6371.0
DEG_KM = 111.32
# WGS84 semi-major axis [km] and flattening.
WGS84_A = 6378.137
WGS84_F = 1 / 298.257223563


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp = F.sin((p2 - p1) / 2)
    dl = F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    h = dp * dp + F.cos(p1) * F.cos(p2) * dl * dl
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * RADIUS_KM)


# Inverse problem on the ellipsoid: the longitude difference on the auxiliary sphere is found by
# a few fixed-point steps, then distance and azimuth follow in closed form.


def _reduced(lat1, lon1, lat2, lon2) -> dict[str, Column]:
    u1, u2 = (F.atan((1 - WGS84_F) * F.tan(F.radians(col(x)))) for x in (lat1, lat2))
    turn = (col(lon2) - col(lon1)) / 360.0
    return {
        "s1": F.sin(u1), "c1": F.cos(u1), "s2": F.sin(u2), "c2": F.cos(u2),
        "l": F.radians((turn - F.floor(turn + 0.5)) * 360.0),
    }


def _arc(v: dict[str, Column], lam: Column):
    sl, cl = F.sin(lam), F.cos(lam)
    x = v["c2"] * sl
    y = v["c1"] * v["s2"] - v["s1"] * v["c2"] * cl
    sin_s = F.sqrt(x * x + y * y)
    cos_s = v["s1"] * v["s2"] + v["c1"] * v["c2"] * cl
    sin_al = F.when(sin_s == 0, 0.0).otherwise(v["c1"] * x / sin_s)
    cos2 = 1 - sin_al * sin_al
    mid = F.when(cos2 == 0, 0.0).otherwise(cos_s - 2 * v["s1"] * v["s2"] / cos2)
    return x, y, sin_s, cos_s, sin_al, cos2, mid


def _closer(v: dict[str, Column], lam: Column) -> Column:
    f = WGS84_F
    _x, _y, sin_s, cos_s, sin_al, cos2, mid = _arc(v, lam)
    c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
    wide = F.atan2(sin_s, cos_s) + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))
    return v["l"] + (1 - c) * f * sin_al * wide


def _solved(v: dict[str, Column], lam: Column) -> tuple[Column, Column]:
    a = WGS84_A
    b = a * (1 - WGS84_F)
    x, y, sin_s, cos_s, _sin_al, cos2, mid = _arc(v, lam)
    k2 = cos2 * (a * a - b * b) / (b * b)
    big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    m2 = 2 * mid * mid - 1
    tail = big_b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)
    corr = big_b * sin_s * (mid + big_b / 4 * (cos_s * m2 - tail))
    return b * big_a * (F.atan2(sin_s, cos_s) - corr), F.degrees(F.atan2(x, y))


def geodesic(lat1, lon1, lat2, lon2, steps: int = 12) -> Column:
    """``struct<km, azimuth>`` of the WGS84 inverse problem, azimuth in degrees at point 1.

    One Column for use anywhere; for bulk work ``with_geodesic`` stays in generated code.
    """
    v = _reduced(lat1, lon1, lat2, lon2)
    names = list(v)

    def solve(p: Column) -> Column:
        w = {k: p[k] for k in names}
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), w["l"], lambda x, _i: _closer(w, x))

        def finish(x: Column) -> Column:
            km, azimuth = _solved(w, x)
            return F.struct(km.alias("km"), azimuth.alias("azimuth"))

        return F.transform(F.array(lam), finish)[0]

    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in v.items()])), solve)[0]


def with_geodesic(
    df: DataFrame, lat1, lon1, lat2, lon2, km: str = "dist_km", azimuth: str | None = None, steps: int = 3
) -> DataFrame:
    """Add WGS84 distance and azimuth columns in generated code.

    Each intermediate value is a column of its own projection, so no formula is copied. A step
    gains a factor of about 1/298; three are exact to well below a millimetre for points that are
    not nearly antipodal.
    """
    df = df.withColumns({f"_g_{k}": c for k, c in _reduced(lat1, lon1, lat2, lon2).items()})
    s1, c1, s2, c2, big_l = (F.col(f"_g_{k}") for k in ("s1", "c1", "s2", "c2", "l"))
    x, y, sin_s, cos_s, sin_al, cos2, mid = (
        F.col(f"_g_{k}") for k in ("x", "y", "sin_s", "cos_s", "sin_al", "cos2", "mid")
    )
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)

    def arc(d: DataFrame, lam: Column) -> DataFrame:
        d = d.withColumns({"_g_x": c2 * F.sin(lam), "_g_cl": F.cos(lam)})
        d = d.withColumns({"_g_y": c1 * s2 - s1 * c2 * F.col("_g_cl"), "_g_cos_s": s1 * s2 + c1 * c2 * F.col("_g_cl")})
        d = d.withColumn("_g_sin_s", F.sqrt(x * x + y * y))
        d = d.withColumn("_g_sin_al", F.when(sin_s == 0, 0.0).otherwise(c1 * x / sin_s))
        d = d.withColumn("_g_cos2", 1 - sin_al * sin_al)
        return d.withColumn("_g_mid", F.when(cos2 == 0, 0.0).otherwise(cos_s - 2 * s1 * s2 / cos2))

    df = df.withColumn("_g_lam", big_l)
    for _ in range(steps):
        df = arc(df, F.col("_g_lam")).withColumn("_g_c", f / 16 * cos2 * (4 + f * (4 - 3 * cos2)))
        c = F.col("_g_c")
        wide = F.atan2(sin_s, cos_s) + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))
        df = df.withColumn("_g_lam", big_l + (1 - c) * f * sin_al * wide)
    df = arc(df, F.col("_g_lam")).withColumn("_g_k2", cos2 * ((a * a - b * b) / (b * b)))
    k2, big_a, big_b = F.col("_g_k2"), F.col("_g_a"), F.col("_g_b")
    df = df.withColumns({
        "_g_a": 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))),
        "_g_b": k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))),
    })
    tail = big_b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)
    corr = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid * mid - 1) - tail))
    out = {km: b * big_a * (F.atan2(sin_s, cos_s) - corr)}
    if azimuth:
        out[azimuth] = F.degrees(F.atan2(x, y))
    names = ("s1", "c1", "s2", "c2", "l", "x", "y", "cl", "sin_s", "cos_s", "sin_al", "cos2", "mid", "lam", "c", "k2", "a", "b")
    return settle(df, out).drop(*[f"_g_{k}" for k in names])


def with_haversine(df: DataFrame, lat1, lon1, lat2, lon2, km: str = "dist_km", azimuth: str | None = None) -> DataFrame:
    """The same columns on the sphere."""
    out = {km: haversine_km(lat1, lon1, lat2, lon2)}
    if azimuth:
        p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
        dl = F.radians(col(lon2)) - F.radians(col(lon1))
        out[azimuth] = F.degrees(
            F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))
        )
    return settle(df, out)


def km_errors(sd_lat, sd_lon, lat) -> Column:
    """Standard deviations in degrees -> ``struct<err_lat_km, err_lon_km>``."""
    return F.struct(
        (col(sd_lat) * DEG_KM).alias("err_lat_km"),
        (col(sd_lon) * DEG_KM * F.cos(F.radians(col(lat)))).alias("err_lon_km"),
    )


def error_ellipse(lon, lat, err_lon_km, err_lat_km, corners: int = 32) -> Column:
    """Closed ring ``array<struct<lon, lat>>`` around a hypocenter, null when not finite."""
    lon, lat, ex, ey = col(lon), col(lat), col(err_lon_km), col(err_lat_km)
    rx = F.greatest(ex, F.lit(1e-6)) / (DEG_KM * F.greatest(F.cos(F.radians(lat)), F.lit(1e-5)))
    ry = F.greatest(ey, F.lit(1e-6)) / DEG_KM
    angle = lambda i: (i % corners) * (2 * math.pi / corners)
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(corners)),
        lambda i: F.struct(
            (lon + rx * F.cos(angle(i))).alias("lon"), (lat + ry * F.sin(angle(i))).alias("lat")
        ),
    )
    return F.when(finite(lon) & finite(lat) & finite(ex) & finite(ey), ring)


# ---- cells for range joins -------------------------------------------------------------------
# Rows of equal latitude height; each row is cut into as many columns as fit its widest parallel,
# so a cell is never wider or higher than ``size_km`` and rows near the poles stay cheap.

_ROW = 4_294_967_296


def _step_deg(size_km: float) -> float:
    return math.degrees(size_km / RADIUS_KM)


def _columns_in(row: Column, step: float) -> Column:
    south = row * step - 90.0
    north = south + step
    nearest = F.when((south <= 0) & (north >= 0), 0.0).otherwise(
        F.least(F.abs(south), F.abs(north))
    )
    return F.greatest(F.ceil(360.0 * F.cos(F.radians(nearest)) / step), F.lit(1))


def _unit(lon: Column) -> Column:
    turn = (lon + 180.0) / 360.0
    return turn - F.floor(turn)


def cell_id(lat, lon, size_km: float) -> Column:
    """Cell number of a point; longitude wraps at the antimeridian."""
    lat, lon = col(lat), col(lon)
    step = _step_deg(size_km)
    row = F.floor((lat + 90.0) / step)
    n = _columns_in(row, step)
    return row * _ROW + F.least(F.floor(_unit(lon) * n), n - 1)


def look_around(df: DataFrame, lat: str, lon: str, radius_km: float, size_km: float, name: str) -> DataFrame:
    """One row per cell that can hold a point within ``radius_km``, its number in ``name``.

    Latitude rows first, then the columns of each row, both in generated code. ``_half`` keeps the
    half width of the disc in degrees of longitude for ``in_box``.
    """
    step = _step_deg(size_km)
    reach = min(radius_km * (1 + 1e-9) / RADIUS_KM + 1e-12, math.pi)
    deg = math.degrees(reach)
    last = math.floor(180.0 / step)
    y, x = F.col(lat), F.col(lon)
    row = lambda v: F.least(F.greatest(F.floor((v + 90.0) / step), F.lit(0)), F.lit(last)).cast("bigint")
    # Half width in longitude; the whole circle when the disc holds a pole.
    ratio = math.sin(min(reach, math.pi / 2)) / F.cos(F.radians(y))
    half = F.when(
        (F.abs(y) + deg < 90.0) & (ratio < 1), F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-12
    ).otherwise(180.0)
    df = df.withColumn("_half", half).withColumn("_row", F.explode(F.sequence(row(y - deg), row(y + deg))))
    df = df.withColumn("_cols", _columns_in(F.col("_row"), step).cast("bigint"))
    n, half = F.col("_cols"), F.col("_half")
    whole = half >= 179.999
    df = df.withColumn("_first", F.when(whole, 0).otherwise(F.floor((x - half + 180.0) / 360.0 * n)).cast("bigint"))
    first = F.col("_first")
    end = F.when(whole, n - 1).otherwise(F.least(F.floor((x + half + 180.0) / 360.0 * n), first + n - 1)).cast("bigint")
    df = df.withColumn("_col", F.explode(F.sequence(first, end)))
    return df.withColumn(name, F.col("_row") * _ROW + F.pmod("_col", n)).drop("_row", "_cols", "_first", "_col")


def in_box(radius_km: float, lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Cheap bound for rows of ``look_around``: no point within the radius fails it."""
    deg = math.degrees(radius_km / RADIUS_KM) * (1 + 1e-9) + 1e-9
    turn = F.pmod(F.col(lon2) - F.col(lon1) + 540.0, F.lit(360.0)) - 180.0
    return (F.abs(F.col(lat1) - F.col(lat2)) <= deg) & (F.abs(turn) <= F.col("_half") + 1e-9)
