"""Registered queries: name -> (Spark query, the same result in SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import views as v
from .functions import geo, measure, times
from .functions.measure import round6
from .operators import density, filters, joins, picks, ranks, sets, stats, waves
from .oracle import (
    EPS, MIN_PTS, RESID, TD, TD_KM, TD_RESID, TD_WHOLE, TIMES, density as density_sql, describe, histogram, km, near, r6, using,
)
from .plans import cluster_job as cluster_plan, locate, relocate as relocate_plan, traveltime
from .session import cut

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles to 6 decimals, the rest as it is."""
    cols = [round6(c).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
STRAIGHT = traveltime.StraightModel.constant(3.5)
CAT = "event_id, ts, lat, lon, depth_km, err_lat_km, err_lon_km, err_dep_km, rms, mode, cid"
CAT_R = ", ".join(c if c in ("event_id", "ts", "mode", "cid") else f"{r6(c)} AS {c}" for c in CAT.split(", "))


# ---- projections and scalars -------------------------------------------------------------------

@query("time_formats", using("catalog", f"""SELECT event_id, {ISO} AS iso, strftime(ts, '%y%m%d.%H%M%S') AS compact,
  strftime(ts, '%Y-%m-%dT%H:%M') AS minute, strftime(ts, '%y%m%d.%H%M%S') AS from_name, {ISO} AS round_trip FROM catalog"""))
def time_formats(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    compact = times.to_compact(iso)
    return v.catalog(spark, sf).select(
        "event_id", times.to_iso(iso).alias("iso"), compact.alias("compact"), times.minute_key(iso).alias("minute"),
        times.time_from_filename(F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".dat"))).alias("from_name"),
        times.to_iso(compact).alias("round_trip"),
    )


@query("mode_codes", using("catalog", """SELECT event_id, mode AS code, CASE mode WHEN 'LMO' THEN 'Levenberg-Marquardt' WHEN 'TRD' THEN 'Triple Difference'
  WHEN 'GRD' THEN 'Grid Search' ELSE lower(mode) END AS name FROM catalog"""))
def mode_codes(spark, sf):
    name = times.mode_name(F.lower("mode"))
    return v.catalog(spark, sf).select(
        "event_id", F.when(F.col("mode").isin("REF", "ERR"), F.upper(times.mode_code(name))).otherwise(times.mode_code(name)).alias("code"), name.alias("name")
    )


@query("scalars", using("catalog", f"""SELECT event_id, {r6(km('lat', 'lon', '40e0', '142e0'))} AS km, {r6('abs(1e0 / ((rms - 0.5e0) + 1e-10))')} AS weight,
  {r6('least(greatest((rms - 0.1e0) / 0.7e0, 0e0), 1e0)')} AS scaled, {r6('greatest(least(depth_km, 40e0), 10.01e0)')} AS depth_km,
  {r6('err_lat_km / 100e0 * 111.32e0')} AS sd_lat_km, {r6('err_lon_km / 100e0 * 111.32e0 * cos(radians(lat))')} AS sd_lon_km FROM catalog"""))
def scalars(spark, sf):
    cat = v.catalog(spark, sf).withColumn("e", geo.km_errors(F.col("err_lat_km") / 100, F.col("err_lon_km") / 100, "lat"))
    return rounded(cat.select(
        "event_id", geo.haversine_km("lat", "lon", F.lit(40.0), F.lit(142.0)).alias("km"), measure.residual_weight(F.col("rms") - 0.5).alias("weight"),
        measure.scaled("rms", 0.1, F.lit(0.1) + F.lit(0.7)).alias("scaled"), measure.clamp_depth("depth_km", 10.01, 40.0).alias("depth_km"),
        F.col("e.err_lat_km").alias("sd_lat_km"), F.col("e.err_lon_km").alias("sd_lon_km"),
    ))


@query("error_ellipses", using("catalog", f"""SELECT event_id, CAST(i AS INT) AS i,
  {r6('lon + greatest(err_lon_km, 1e-6) / (111.32e0 * greatest(cos(radians(lat)), 1e-5)) * cos((i % 32) * (2 * pi() / 32))')} AS lon,
  {r6('lat + greatest(err_lat_km, 1e-6) / 111.32e0 * sin((i % 32) * (2 * pi() / 32))')} AS lat FROM catalog, range(33) r(i)"""))
def error_ellipses(spark, sf):
    ring = F.posexplode(geo.error_ellipse("lon", "lat", "err_lon_km", "err_lat_km")).alias("i", "p")
    return rounded(v.catalog(spark, sf).select("event_id", ring).select("event_id", "i", "p.lon", "p.lat"))


@query("geodesic_distance")
def geodesic_distance(spark, sf):
    cat = v.catalog(spark, sf).withColumns({"lat0": F.lit(40.0), "lon0": F.lit(142.0)})
    return rounded(geo.with_geodesic(cat, "lat", "lon", "lat0", "lon0", "km", "azimuth").select("event_id", "km", "azimuth"))


# ---- filters -----------------------------------------------------------------------------------

@query("screen", using("catalog", f"""SELECT {CAT_R} FROM catalog WHERE rms >= 0.1e0 AND rms <= 0.6e0 AND depth_km >= 8e0 AND depth_km <= 40e0
  AND lat >= 38e0 AND lat <= 40e0 AND err_lat_km <= 1.5e0 AND ts >= TIMESTAMP '1993-01-01' AND ts <= TIMESTAMP '1998-06-30' AND cid >= 1 AND cid <= 30 AND mode IN ('LMO', 'TRD')"""))
def screen(spark, sf):
    hits = filters.screen(
        v.catalog(spark, sf), rms=(0.1, 0.6), depth=(8.0, 40.0), lat=(38.0, 40.0), err_lat=(None, 1.5), cid=(1, 30), modes=["LMO", "TRD"],
        time=("1993-01-01", "1998-06-30"),
    )
    return rounded(hits.select(*CAT.split(", ")))


@query("quality_filter", using("catalog", "SELECT event_id FROM catalog WHERE rms <= 0.5e0 AND err_lat_km <= 1e0 AND err_lon_km <= 1e0"))
def quality_filter(spark, sf):
    return filters.quality_filter(v.catalog(spark, sf), 0.5, 1.0).select("event_id")


@query("filter_report", using("catalog", """SELECT count(*) AS total, count(*) FILTER (rms <= 0.5e0 AND err_lat_km <= 1e0 AND err_lon_km <= 1e0) AS passed,
  count(*) FILTER (rms > 0.5e0) AS removed_rms, count(*) FILTER (rms <= 0.5e0 AND (err_lat_km > 1e0 OR err_lon_km > 1e0)) AS removed_error FROM catalog"""))
def filter_report(spark, sf):
    return stats.filter_report(v.catalog(spark, sf), 0.5, 1.0)


@query("threshold_lags", using("lags", "SELECT event_id, stn_k, stn_l, lag, weight FROM lags WHERE weight >= 0.5e0"))
def threshold_lags(spark, sf):
    return filters.threshold_lags(v.lags(spark, sf), 0.5)


@query("valid_stations", using("stations", "SELECT stn_idx, lat + 40e0 + stn_idx AS lat, lon, lat + 40e0 + stn_idx <= 90 AND lon <= 180 AS ok FROM stations"))
def valid_stations(spark, sf):
    st = v.stations(spark, sf).select("stn_idx", (F.col("lat") + 40.0 + F.col("stn_idx")).alias("lat"), "lon")
    good, bad = filters.valid_stations(st)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


@query("resolve_cid", using("catalog", "SELECT event_id, cid FROM catalog"))
def resolve_cid(spark, sf):
    return filters.resolve_cid(v.catalog(spark, sf), False).select("event_id", "cid")


# Ids that are missing count as 0; if none is known, all events are one cluster, or none when they are to be clustered.
CID_CASES = {"some": "CASE WHEN event_id % 3 > 0 THEN cid END", "none": "CAST(NULL AS INT)"}


@query("resolve_cid_cases", using("catalog", f"""SELECT event_id, CAST(coalesce({CID_CASES['some']}, 0) AS INT) AS some_kept, CAST(coalesce({CID_CASES['some']}, 0) AS INT) AS some_again,
  CAST(1 AS INT) AS none_kept, CAST(NULL AS INT) AS none_again FROM catalog"""))
def resolve_cid_cases(spark, sf):
    out = v.catalog(spark, sf).select("event_id")
    for case, cid in CID_CASES.items():
        for name, again in (("kept", False), ("again", True)):
            got = filters.resolve_cid(v.catalog(spark, sf).withColumn("cid", F.expr(cid)), again)
            out = out.join(got.select("event_id", F.col("cid").alias(f"{case}_{name}")), "event_id")
    return out


@query("depth_status", using("catalog stations", "SELECT event_id, CASE WHEN depth_km BETWEEN (SELECT greatest(max(dep_km), 0) + 0.01e0 FROM stations) AND 40e0 THEN mode ELSE 'ERR' END AS mode FROM catalog"))
def depth_status(spark, sf):
    top = stats.bottom_depth(v.stations(spark, sf)).scalar()
    return filters.depth_status(v.catalog(spark, sf), top, 40.0).select("event_id", "mode")


@query("in_cluster", using("catalog", "SELECT event_id, cid FROM catalog WHERE cid = 7"))
def in_cluster(spark, sf):
    return filters.in_cluster(v.catalog(spark, sf), 7).select("event_id", "cid")


# ---- joins -------------------------------------------------------------------------------------

@query("resolve_lag_stations", using("lags stations", "SELECT l.event_id, l.lag, a.stn_idx AS stn_k, b.stn_idx AS stn_l FROM lags l JOIN stations a ON a.stn_idx = l.stn_k AND a.stn_idx <> 3 JOIN stations b ON b.stn_idx = l.stn_l AND b.stn_idx <> 3"))
def resolve_lag_stations(spark, sf):
    st = v.stations(spark, sf)
    codes = v.lags(spark, sf)
    for end in ("k", "l"):
        codes = codes.join(st.select(F.col("stn_idx").alias(f"stn_{end}"), F.col("code").alias(f"code_{end}")), f"stn_{end}").drop(f"stn_{end}")
    # A station missing from the table: its rows drop.
    return joins.resolve_lag_stations(codes, st.where("stn_idx <> 3")).select("event_id", "lag", "stn_k", "stn_l")


@query("attach_lags", using("catalog lags", """SELECT event_id, event_id % 2 = 0 OR event_id % 3 = 0 AS has_lags FROM catalog"""))
def attach_lags(spark, sf):
    # Half of the lag files match by name, a third by the time in the name.
    cat = v.catalog(spark, sf).withColumn("time_raw", F.concat(F.lpad(F.col("event_id") % 1_000_000, 6, "0"), F.lit("."), F.lpad(F.floor(F.col("event_id") / 1_000_000), 6, "0")))
    cat = cat.withColumn("file", F.concat(F.lit("f"), "event_id"))
    by_name = cat.where("event_id % 2 = 0").select("file", F.col("event_id").alias("dat_id"))
    by_time = cat.where("event_id % 3 = 0").select(F.concat("time_raw", F.lit(".dat")).alias("file"), F.col("event_id").alias("dat_id"))
    return joins.attach_lags(cat, by_name.unionByName(by_time)).where("dat_id is null or dat_id = event_id").select("event_id", "has_lags")


@query("attach_lags_ids", using("catalog", """SELECT c.event_id, coalesce(f.dat_id, t.dat_id) AS dat_id, coalesce(f.dat_id, t.dat_id) IS NOT NULL AS has_lags FROM catalog c
  LEFT JOIN (SELECT event_id - event_id % 3 AS event_id, min(event_id * 2) AS dat_id FROM catalog GROUP BY 1) f ON f.event_id = c.event_id
  LEFT JOIN (SELECT ts, min(event_id) AS dat_id FROM catalog WHERE event_id % 5 = 0 GROUP BY 1) t ON t.ts = c.ts"""))
def attach_lags_ids(spark, sf):
    """Files that share a name or a time: the smallest id of the name, else the smallest of the time."""
    cat = v.catalog(spark, sf).withColumns({"time_raw": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "file": F.concat(F.lit("f"), "event_id")})
    by_name = cat.select(F.concat(F.lit("f"), F.col("event_id") - F.col("event_id") % 3).alias("file"), (F.col("event_id") * 2).alias("dat_id"))
    by_time = cat.where("event_id % 5 = 0").select(F.date_format("ts", "yyMMdd.HHmmss'.dat'").alias("file"), F.col("event_id").alias("dat_id"))
    return joins.attach_lags(cat, by_name.unionByName(by_time)).select("event_id", "dat_id", "has_lags")


@query("event_station", using("catalog stations", f"SELECT event_id, stn_idx, {r6('dist_km')} AS dist_km FROM pairs", TIMES))
def event_station(spark, sf):
    return rounded(joins.event_station(v.catalog(spark, sf), v.stations(spark, sf)).select("event_id", "stn_idx", "dist_km"))


@query("station_pairs", using("stations", "SELECT a.stn_idx AS stn_k, b.stn_idx AS stn_l FROM stations a JOIN stations b ON a.stn_idx < b.stn_idx"))
def station_pairs(spark, sf):
    return joins.station_pairs(v.stations(spark, sf)).select("stn_k", "stn_l")


@query("neighbors", using("catalog", f"SELECT event_a, event_b, {r6('dist_km')} AS dist_km FROM near_n", near("n", 0.3)))
def neighbors(spark, sf):
    return rounded(joins.neighbors(v.catalog(spark, sf), 0.3))


@query("triple_differences", using("catalog lags", f"SELECT cid, eve0, eve1, stn_k, stn_l, {r6('td')} AS td, {r6('dist_km')} AS dist_km FROM td", TD_WHOLE))
def triple_differences(spark, sf):
    """Every pair of a cluster."""
    return rounded(joins.triple_differences(v.catalog(spark, sf, order=True), v.lags(spark, sf), wgs84=False))


def _td(spark, sf):
    return joins.triple_differences(v.catalog(spark, sf, order=True), v.lags(spark, sf), max_km=TD_KM, wgs84=False)


def _unformed(spark, sf):
    return joins.differences(v.catalog(spark, sf, order=True), v.lags(spark, sf), max_km=TD_KM, wgs84=False)


def _times(spark, sf):
    pairs = joins.event_station(v.catalog(spark, sf), v.stations(spark, sf))
    return traveltime.travel_times(pairs, STRAIGHT).select("event_id", "stn_idx", "tt")


def _tdr(spark, sf):
    return relocate_plan.model_residual(_unformed(spark, sf), v.catalog(spark, sf), v.stations(spark, sf), STRAIGHT, wgs84=False)


@query("td_residual_from_times", using("catalog lags stations", f"SELECT cid, eve0, eve1, stn_k, stn_l, {r6('residual')} AS residual FROM tdr", TD_RESID))
def td_residual_from_times(spark, sf):
    """The same from a table of travel times, whatever made it."""
    return rounded(joins.td_residual(_unformed(spark, sf), _times(spark, sf)).drop("dist_km", "td"))


@query("triple_difference_count", using("catalog lags", """SELECT a.cid, count(*) AS n, CAST(count(DISTINCT a.event_id) AS BIGINT) AS n_first
  FROM (SELECT l.*, c.cid, c.event_ord, c.mode FROM lags l JOIN catalog c USING (event_id) WHERE cid > 0 AND mode <> 'ERR') a
  JOIN (SELECT l.*, c.cid, c.event_ord, c.mode FROM lags l JOIN catalog c USING (event_id) WHERE cid > 0 AND mode <> 'ERR') b
  ON a.cid = b.cid AND a.stn_k = b.stn_k AND a.stn_l = b.stn_l AND a.event_ord < b.event_ord WHERE NOT (a.mode = 'REF' AND b.mode = 'REF') GROUP BY a.cid"""))
def triple_difference_count(spark, sf):
    return joins.differences(v.catalog(spark, sf, order=True), v.lags(spark, sf), wgs84=False).counts()


@query("td_residual", using("catalog lags stations", f"SELECT cid, eve0, eve1, stn_k, stn_l, {r6('td')} AS td, {r6('residual')} AS residual FROM tdr", TD_RESID))
def td_residual(spark, sf):
    return rounded(_tdr(spark, sf).drop("dist_km"))


@query("td_within", using("catalog lags", f"SELECT eve0, eve1, stn_k, stn_l, {r6('dist_km')} AS dist_km FROM td WHERE dist_km < 0.5e0", TD))
def td_within(spark, sf):
    return rounded(filters.td_within(_td(spark, sf), 0.5).select("eve0", "eve1", "stn_k", "stn_l", "dist_km"))


@query("drop_ref_pairs", using("catalog lags", f"""SELECT t.eve0, t.eve1, t.stn_k, t.stn_l FROM td t JOIN catalog a ON a.event_id = t.eve0 JOIN catalog b ON b.event_id = t.eve1
  WHERE NOT (a.mode IN ('REF', 'ERR') AND b.mode IN ('REF', 'ERR'))""", TD))
def drop_ref_pairs(spark, sf):
    return filters.drop_ref_pairs(_unformed(spark, sf), v.catalog(spark, sf)).select("eve0", "eve1", "stn_k", "stn_l")


@query("match_catalogs", using("catalog catalog_b", f"""SELECT a.minute, 'a' AS source_a, 'b' AS source_b, a.event_id AS event_a, b.event_id AS event_b, {r6('b.lat - a.lat')} AS d_lat,
  {r6('b.lon - a.lon')} AS d_lon, {r6('b.depth_km - a.depth_km')} AS d_dep, {r6(km('a.lat', 'a.lon', 'b.lat', 'b.lon'))} AS km FROM fa a JOIN fb b USING (minute)""",
  """fa AS (SELECT * FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%dT%H:%M') ORDER BY event_ord) AS r FROM catalog) WHERE r = 1),
  fb AS (SELECT * FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%dT%H:%M') ORDER BY event_ord) AS r FROM catalog_b) WHERE r = 1)"""))
def match_catalogs(spark, sf):
    return rounded(joins.match_catalogs({"a": v.catalog(spark, sf, order=True), "b": v.catalog_b(spark, sf, order=True)}))


def _runs(spark, sf):
    cat = v.catalog(spark, sf)
    inputs = cat.select(F.col("event_id").alias("ord"), F.concat(F.lit("e"), "event_id").alias("event"))
    results = cat.where("event_id % 7 <> 0").select(
        F.concat(F.lit("e"), "event_id").alias("event"), F.when(F.col("mode") == "ERR", "FAILED").otherwise("OK").alias("status"), F.lit(1).alias("hypocenters"),
        F.lit(3).alias("iterations"), F.lit(9).alias("evaluations"), F.lit(5).cast("bigint").alias("elapsed_ms"), F.col("rms").alias("final_rms"), F.lit(None).cast("string").alias("note"),
    )
    return joins.run_summary(inputs, results)


@query("run_summary", using("catalog", f"""SELECT event_id AS ord, 'e' || event_id AS event, CASE WHEN event_id % 7 = 0 THEN 'SKIPPED' WHEN mode = 'ERR' THEN 'FAILED' ELSE 'OK' END AS status,
  CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS hypocenters, CASE WHEN event_id % 7 <> 0 THEN {r6('rms')} END AS final_rms, CASE WHEN event_id % 7 = 0 THEN 'No result recorded' ELSE '' END AS note FROM catalog"""))
def run_summary(spark, sf):
    return rounded(_runs(spark, sf).drop("iterations", "evaluations", "elapsed_ms"))


@query("run_totals", using("catalog", "SELECT CASE WHEN event_id % 7 = 0 THEN 'SKIPPED' WHEN mode = 'ERR' THEN 'FAILED' ELSE 'OK' END AS status, count(*) AS n FROM catalog GROUP BY 1"))
def run_totals(spark, sf):
    return stats.run_totals(_runs(spark, sf))


@query("latest_picks", using("picks latest", "SELECT event_id, station, phase, component, ts FROM latest"))
def latest_picks(spark, sf):
    return picks.latest_picks(v.picks(spark, sf))


@query("pick_offsets", using("picks channels latest", f"""SELECT l.event_id, c.channel, CASE WHEN l.phase = 'P' THEN 0 ELSE 1 END AS phase_code,
  {r6('(epoch_us(l.ts) // 1000 - epoch_us(r.m) // 1000) / 1000e0')} AS offset_s, {r6('(epoch_us(l.ts) // 1000 - epoch_us(r.m) // 1000) / 1000e0 + 0.5e0')} AS offset2_s FROM latest l
  JOIN (SELECT event_id, date_trunc('minute', min(ts)) AS m FROM latest WHERE phase = 'P' GROUP BY 1) r USING (event_id)
  JOIN channels c ON CAST(c.station AS VARCHAR) = l.station AND c.component = l.component WHERE l.ts >= r.m"""))
def pick_offsets(spark, sf):
    off = picks.pick_offsets(picks.latest_picks(v.picks(spark, sf)), v.channels(spark, sf), 0.5)
    return rounded(off.select("event_id", "channel", "phase_code", "offset_s", "offset2_s"))


@query("missing_lags", using("catalog lags", "SELECT event_id FROM catalog WHERE event_id NOT IN (SELECT event_id FROM lags)"))
def missing_lags(spark, sf):
    return joins.missing_lags(v.catalog(spark, sf), v.lags(spark, sf)).select("event_id")


@query("missing_td", using("catalog lags", "SELECT DISTINCT cid FROM catalog WHERE cid > 0 AND cid NOT IN (SELECT cid FROM td)", TD))
def missing_td(spark, sf):
    return joins.missing_td(v.catalog(spark, sf), _unformed(spark, sf))


@query("in_use_stations", using("stations lags", "SELECT stn_idx, code FROM stations WHERE stn_idx IN (SELECT stn_k FROM lags UNION SELECT stn_l FROM lags)"))
def in_use_stations(spark, sf):
    return joins.in_use_stations(v.stations(spark, sf), v.lags(spark, sf)).select("stn_idx", "code")


@query("lag_view", using("lags stations", "SELECT l.event_id, l.seq, coalesce(a.code, '?') AS code_k, coalesce(b.code, '?') AS code_l, l.lag, l.weight FROM lags l LEFT JOIN stations a ON a.stn_idx = l.stn_k AND a.stn_idx <> 4 LEFT JOIN stations b ON b.stn_idx = l.stn_l AND b.stn_idx <> 4"))
def lag_view(spark, sf):
    return joins.lag_view(v.lags(spark, sf, seq=True), v.stations(spark, sf).where("stn_idx <> 4"))


# ---- statistics --------------------------------------------------------------------------------

@query("describe_columns", describe())
def describe_columns(spark, sf):
    return rounded(stats.describe_columns(v.catalog(spark, sf)))


@query("histogram_report", histogram(False))
def histogram_report(spark, sf):
    return rounded(stats.histogram(v.catalog(spark, sf), ["depth_km", "rms", "err_dep_km"]))


@query("histogram_viewer", histogram(True))
def histogram_viewer(spark, sf):
    return rounded(stats.histogram(v.catalog(spark, sf), ["depth_km", "rms", "err_dep_km"], mode="viewer"))


@query("robust_range", using("catalog", f"""SELECT {r6('max(CASE WHEN r = floor((n - 1) * 0.02e0) + 1 THEN depth_km END)')} AS lo, {r6('max(CASE WHEN r = ceil((n - 1) * 0.98e0) + 1 THEN depth_km END)')} AS hi
  FROM (SELECT depth_km, row_number() OVER (ORDER BY depth_km) AS r, count(*) OVER () AS n FROM catalog)"""))
def robust_range(spark, sf):
    return rounded(stats.robust_range(v.catalog(spark, sf), "depth_km"))


@query("cluster_sizes", using("catalog", "SELECT cid, count(*) AS n_events FROM catalog GROUP BY cid"))
def cluster_sizes(spark, sf):
    return stats.cluster_sizes(v.catalog(spark, sf))


@query("ref_point", using("stations", f"SELECT {r6('median(lat)')} AS lat, {r6('median(lon)')} AS lon FROM stations"))
def ref_point(spark, sf):
    return rounded(stats.ref_point(v.stations(spark, sf)))


@query("bottom_depth", using("stations", f"SELECT {r6('greatest(max(dep_km), 0) + 0.01e0')} AS bottom_km FROM stations"))
def bottom_depth(spark, sf):
    return rounded(stats.bottom_depth(v.stations(spark, sf)))


@query("event_lag_counts", using("catalog lags", """SELECT c.event_id, coalesce(n_lags, 0) AS n_lags, coalesce(n_stations, 0) AS n_stations, n_lags IS NOT NULL AS has_lags FROM catalog c
  LEFT JOIN (SELECT event_id, count(*) AS n_lags FROM lags GROUP BY 1) a USING (event_id)
  LEFT JOIN (SELECT event_id, count(DISTINCT s) AS n_stations FROM (SELECT event_id, stn_k AS s FROM lags UNION ALL SELECT event_id, stn_l FROM lags) GROUP BY 1) b USING (event_id)"""))
def event_lag_counts(spark, sf):
    return stats.event_lag_counts(v.catalog(spark, sf), v.lags(spark, sf))


def _resid(spark, sf):
    obs = locate.observations(v.lags(spark, sf, seq=True), v.stations(spark, sf))
    return locate.residual_table(obs, v.catalog(spark, sf), STRAIGHT, wgs84=False)


@query("residual_table", using("catalog lags stations", f"SELECT event_id, seq, {r6('calc')} AS calc, {r6('residual')} AS residual FROM resid", RESID))
def residual_table(spark, sf):
    return rounded(_resid(spark, sf).select("event_id", "seq", "calc", "residual"))


@query("misfit", using("catalog lags stations", f"SELECT event_id, count(*) AS n, {r6('stddev_pop(residual)')} AS misfit FROM resid GROUP BY event_id", RESID))
def misfit(spark, sf):
    return rounded(locate.misfit(_resid(spark, sf)))


@query("rms", using("catalog lags stations", f"SELECT event_id, {r6('sqrt(avg(residual * residual))')} AS rms FROM resid GROUP BY event_id", RESID))
def rms(spark, sf):
    return rounded(locate.rms(_resid(spark, sf)))


@query("log_likelihood", using("catalog lags stations", f"SELECT event_id, {r6('-sum(residual * residual)')} AS loglik FROM resid GROUP BY event_id", RESID))
def log_likelihood(spark, sf):
    return rounded(locate.log_likelihood(_resid(spark, sf)))


@query("posterior_summary", using("catalog", f"""SELECT cid AS event_id, count(*) AS n, {r6('avg(lat)')} AS mean_lat, {r6('stddev_pop(lat) * 111.32e0')} AS err_lat_km,
  {r6('stddev_pop(lon) * 111.32e0 * cos(radians(max_by(lat, -rms * 1e7 - event_id)))')} AS err_lon_km, {r6('max_by(depth_km, -rms * 1e7 - event_id)')} AS best_depth_km FROM catalog GROUP BY cid"""))
def posterior_summary(spark, sf):
    samples = v.catalog(spark, sf).select(F.col("cid").alias("event_id"), "lat", "lon", "depth_km", (-F.col("rms") * 1e7 - F.col("event_id")).alias("loglik"))
    out = stats.posterior_summary(samples)
    return rounded(out.select("event_id", "n", "mean_lat", "err_lat_km", "err_lon_km", "best_depth_km"))


def _candidates(spark, sf):
    return v.catalog(spark, sf).select(
        F.col("cid").alias("event_id"), F.col("event_id").alias("ord"), F.col("rms").alias("misfit"), "lat", "lon", "depth_km"
    )


@query("best_candidate", using("catalog", f"SELECT event_id, ord, {r6('misfit')} AS misfit, {r6('lat')} AS lat FROM (SELECT cid AS event_id, event_id AS ord, rms AS misfit, lat, row_number() OVER (PARTITION BY cid ORDER BY rms, event_id) AS r FROM catalog) WHERE r = 1"))
def best_candidate(spark, sf):
    return rounded(stats.best_candidate(_candidates(spark, sf)).select("event_id", "ord", "misfit", "lat"))


@query("elite_spread", using("catalog", f"""SELECT event_id, count(*) AS n, {r6('stddev_pop(lat) * 111.32e0')} AS err_lat_km, {r6('stddev_pop(lon) * 111.32e0 * cos(radians(max(CASE WHEN r = 1 THEN lat END)))')} AS err_lon_km,
  {r6('stddev_pop(depth_km)')} AS err_dep_km FROM (SELECT cid AS event_id, lat, lon, depth_km, row_number() OVER (PARTITION BY cid ORDER BY rms, event_id) AS r FROM catalog) WHERE r <= 10 GROUP BY 1"""))
def elite_spread(spark, sf):
    return rounded(stats.elite_spread(_candidates(spark, sf), 10))


@query("event_td_rms", using("catalog lags stations", f"""SELECT c.event_id, {r6('coalesce(t.rms, c.rms)')} AS rms FROM catalog c LEFT JOIN (SELECT event_id, sqrt(avg(residual * residual)) AS rms
  FROM (SELECT eve0 AS event_id, residual FROM tdr UNION ALL SELECT eve1, residual FROM tdr) GROUP BY 1) t USING (event_id)""", TD_RESID))
def event_td_rms(spark, sf):
    return rounded(stats.event_td_rms(_tdr(spark, sf), v.catalog(spark, sf)).select("event_id", "rms"))


@query("mad_weights", using("catalog lags stations", f"""SELECT event_id, seq, {r6('CASE WHEN abs(residual / (4.685e0 * mad)) > 1 THEN 0 ELSE pow(1 - pow(residual / (4.685e0 * mad), 2), 2) END')} AS weight
  FROM rc JOIN (SELECT cid, median(abs(residual - m)) AS mad FROM rc JOIN (SELECT cid, median(residual) AS m FROM rc GROUP BY cid) USING (cid) GROUP BY cid) USING (cid)""",
  RESID + ", rc AS MATERIALIZED (SELECT r.event_id, r.seq, r.residual, c.cid FROM resid r JOIN catalog c USING (event_id))"))
def mad_weights(spark, sf):
    rows = _resid(spark, sf).drop("weight").join(v.catalog(spark, sf).select("event_id", "cid"), "event_id")
    return rounded(stats.mad_weights(cut(rows), ["cid"]).select("event_id", "seq", "weight"))


@query("cluster_residual_trace", using("catalog", f"""SELECT cid, step + CASE WHEN stage = 1 THEN coalesce(first_steps, 0) ELSE 0 END AS step, {r6('sqrt(sum(rms * rms))')} AS residual_norm
  FROM t LEFT JOIN (SELECT cid, max(step) + 1 AS first_steps FROM t WHERE stage = 0 GROUP BY cid) USING (cid) GROUP BY 1, 2""",
  "t AS (SELECT cid, event_id % 2 AS stage, (event_id // 2) % 10 AS step, rms FROM catalog WHERE cid > 0)"))
def cluster_residual_trace(spark, sf):
    trace = v.catalog(spark, sf).where("cid > 0").selectExpr("cid", "event_id % 2 stage", "event_id div 2 % 10 step", "rms residual")
    return rounded(stats.cluster_residual_trace(trace))


# ---- ranks and curves --------------------------------------------------------------------------

@query("row_numbers", using("catalog", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no FROM catalog"))
def row_numbers(spark, sf):
    return ranks.row_numbers(v.catalog(spark, sf).select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_no")


@query("nth_values", using("catalog", f"SELECT cid, {r6('max(CASE WHEN r = n // 4 + 1 THEN rms END)')} AS q1, {r6('max(CASE WHEN r = n // 2 + 1 THEN rms END)')} AS mid FROM (SELECT cid, rms, row_number() OVER (PARTITION BY cid ORDER BY rms) AS r, count(*) OVER (PARTITION BY cid) AS n FROM catalog) GROUP BY cid"))
def nth_values(spark, sf):
    return rounded(ranks.nth_values(v.catalog(spark, sf), "rms", {"q1": lambda n: F.floor(n / 4), "mid": lambda n: F.floor(n / 2)}, ["cid"]))


KD = f"""kd AS MATERIALIZED (SELECT event_id, kdist_km FROM (SELECT event_a AS event_id, dist_km AS kdist_km, row_number() OVER (PARTITION BY event_a ORDER BY dist_km) AS r FROM near_k) WHERE r = 4),
kf AS MATERIALIZED (SELECT event_id, lat, lon FROM catalog WHERE event_id NOT IN (SELECT event_id FROM kd)),
kall AS MATERIALIZED (SELECT * FROM kd UNION ALL SELECT event_id, d FROM (SELECT event_id, d, row_number() OVER (PARTITION BY event_id ORDER BY d) AS r FROM
  (SELECT f.event_id, {km('f.lat', 'f.lon', 'c.lat', 'c.lon')} AS d FROM kf f JOIN catalog c ON c.event_id <> f.event_id)) WHERE r = 4)"""
KDIST = near("k", 1.0) + ", " + KD
CURVE = KDIST + ", curve AS MATERIALIZED (SELECT kdist_km AS v, row_number() OVER (ORDER BY kdist_km) AS k, count(*) OVER () AS n, min(kdist_km) OVER () AS lo, max(kdist_km) OVER () AS hi FROM kall)"


@query("k_distance", using("catalog", f"SELECT event_id, {r6('kdist_km')} AS kdist_km FROM kall", KDIST))
def k_distance(spark, sf):
    return rounded(density.k_distance(v.catalog(spark, sf), 4))


@query("kdist_curve", using("catalog", f"SELECT k AS rank, {r6('v')} AS kdist_km FROM curve", CURVE))
def kdist_curve(spark, sf):
    return rounded(ranks.kdist_curve(density.k_distance(v.catalog(spark, sf), 4)))


@query("eps_percentile", using("catalog", f"SELECT {r6('v')} AS eps_km FROM curve WHERE k = floor((n - 1) * 0.9e0 + 0.5) + 1", CURVE))
def eps_percentile(spark, sf):
    return rounded(density.auto_eps(v.catalog(spark, sf), 4, 0.9))


@query("eps_elbow", using("catalog", f"""SELECT {r6('v')} AS eps_km FROM curve WHERE k = 1 + (SELECT k FROM curve WHERE k > 1 AND k < n
  ORDER BY abs((hi - lo) * k + (1 - n) * v + n * lo - hi) / sqrt((hi - lo) * (hi - lo) + (1e0 - n) * (1 - n)) DESC, k LIMIT 1)""", CURVE))
def eps_elbow(spark, sf):
    return rounded(density.auto_eps(v.catalog(spark, sf), 4))


@query("scatter_xy", using("catalog catalog_b", f"""SELECT source, count(*) AS n, {r6('min(x)')} AS x_min, {r6('max(x)')} AS x_max, {r6('min(y)')} AS y_min, {r6('max(y)')} AS y_max
  FROM (SELECT 'a' AS source, depth_km AS x, rms AS y FROM catalog UNION ALL SELECT 'b', depth_km, rms FROM catalog_b) GROUP BY 1"""))
def scatter_xy(spark, sf):
    both = sets.union_catalogs({"a": v.catalog(spark, sf), "b": v.catalog_b(spark, sf)})
    return rounded(stats.scatter_xy(both, "depth_km", "rms")[1])


@query("scatter_points", using("catalog catalog_b", f"""SELECT source, {r6('x')} AS x, {r6('y')} AS y FROM
  (SELECT 'a' AS source, nullif(depth_km, 7e0) AS x, rms AS y FROM catalog UNION ALL SELECT 'b', nullif(depth_km, 7e0), rms FROM catalog_b) WHERE x IS NOT NULL"""))
def scatter_points(spark, sf):
    both = sets.union_catalogs({"a": v.catalog(spark, sf), "b": v.catalog_b(spark, sf)})
    return rounded(stats.scatter_xy(both.withColumn("depth_km", F.nullif("depth_km", F.lit(7.0))), "depth_km", "rms")[0])


# ---- waveforms ---------------------------------------------------------------------------------

@query("detrend", using("waves", f"SELECT trace_id, i, {r6('y - (regr_intercept(y, CAST(i AS DOUBLE)) OVER w + regr_slope(y, CAST(i AS DOUBLE)) OVER w * i)')} AS y FROM waves WINDOW w AS (PARTITION BY trace_id)"))
def detrend(spark, sf):
    return rounded(waves.detrend(v.waves(spark, sf).drop("ts")))


BAND = """n1 AS (SELECT trace_id, i, y, greatest(least(5, count(*) OVER (PARTITION BY trace_id) // 2) // 2, 1) AS h FROM waves),
b1 AS MATERIALIZED (SELECT a.trace_id, a.i, a.y - avg(b.y) AS y FROM n1 a JOIN n1 b ON b.trace_id = a.trace_id AND b.i >= a.i - a.h AND b.i < a.i + a.h GROUP BY a.trace_id, a.i, a.y)"""


@query("bandpass", using("waves", f"SELECT trace_id, i, {r6('avg(y) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS y FROM b1", BAND))
def bandpass(spark, sf):
    # One sample per second: a five-sample high pass, then a five-sample low pass.
    return rounded(waves.bandpass(v.waves(spark, sf).drop("ts"), fmin=0.2, fmax=0.1, delta=1.0))


@query("normalize_trace", using("waves", f"SELECT trace_id, i, {r6('CASE WHEN max(abs(y)) OVER (PARTITION BY trace_id) > 0 THEN y / (2 * max(abs(y)) OVER (PARTITION BY trace_id)) ELSE 0 END')} AS y FROM waves"))
def normalize_trace(spark, sf):
    return rounded(waves.normalize_trace(v.waves(spark, sf).drop("ts")))


# ---- sets --------------------------------------------------------------------------------------

@query("union_stations", using("stations", "SELECT stn_idx, code FROM stations UNION ALL SELECT stn_idx, code FROM stations WHERE stn_idx < 10"))
def union_stations(spark, sf):
    st = v.stations(spark, sf).select("stn_idx", "code")
    return sets.union_stations(st, st.where("stn_idx < 10"))


@query("union_catalogs", using("catalog catalog_b", f"SELECT 'a' AS source, event_id, {r6('lat')} AS lat FROM catalog UNION ALL SELECT 'b', event_id, {r6('lat')} FROM catalog_b"))
def union_catalogs(spark, sf):
    both = sets.union_catalogs({"a": v.catalog(spark, sf), "b": v.catalog_b(spark, sf)})
    return rounded(both.select("source", "event_id", "lat"))


@query("uncovered_events", using("catalog lags", "SELECT event_id FROM catalog WHERE event_id NOT IN (SELECT eve0 FROM td UNION SELECT eve1 FROM td)", TD))
def uncovered_events(spark, sf):
    return sets.uncovered_events(v.catalog(spark, sf), _unformed(spark, sf)).select("event_id")


# ---- clustering --------------------------------------------------------------------------------

@query("core_events", using("catalog", f"SELECT event_a AS event_id FROM near_c GROUP BY 1 HAVING count(*) >= {MIN_PTS}", near("c", EPS)))
def core_events(spark, sf):
    return density.core_events(v.catalog(spark, sf, order=True), EPS, MIN_PTS)


@query("dbscan", using("catalog", "SELECT event_id, cid, core FROM dbs", density_sql(), recursive=True))
def dbscan(spark, sf):
    return density.dbscan(v.catalog(spark, sf, order=True), EPS, MIN_PTS)


@query("relabelled", using("catalog", "SELECT event_id, CASE WHEN event_id % 4 > 0 AND cid > 2 THEN cid * 2 ELSE 0 END AS cid FROM catalog"))
def relabelled(spark, sf):
    """New labels of some events; the rest become noise whatever cluster they were in."""
    cat = v.catalog(spark, sf)
    return sets.clusters_plus_noise(cat, cat.where("event_id % 4 > 0 and cid > 2").withColumn("cid", F.col("cid") * 2)).select("event_id", "cid")


@query("clusters_plus_noise", using("catalog", "SELECT event_id, cid FROM catalog"))
def clusters_plus_noise(spark, sf):
    cat = v.catalog(spark, sf)
    return sets.clusters_plus_noise(cat, cat.where("cid > 0")).select("event_id", "cid")


# ---- travel times ------------------------------------------------------------------------------

@query("travel_times", using("catalog stations", f"SELECT event_id, stn_idx, {r6('tt')} AS tt FROM times", TIMES))
def travel_times(spark, sf):
    return rounded(_times(spark, sf))


PATH = "sqrt(dist_km * dist_km + (depth_km - stn_dep) * (depth_km - stn_dep))"
AZIMUTH = ("atan2(sin(radians(s_lon) - radians(lon)) * cos(radians(s_lat)), cos(radians(lat)) * sin(radians(s_lat))"
           " - sin(radians(lat)) * cos(radians(s_lat)) * cos(radians(s_lon) - radians(lon)))")


@query("partials", using("catalog stations", f"""SELECT event_id, stn_idx, {r6('-dist_km / path / 3.5e0 * sin(az) * 111.32e0 * cos(radians(lat))')} AS g_lon,
  {r6('-dist_km / path / 3.5e0 * cos(az) * 111.32e0')} AS g_lat, {r6('(depth_km - stn_dep) / path / 3.5e0')} AS g_dep, {r6('path / 3.5e0 + sc')} AS tt
  FROM (SELECT *, {PATH} AS path, {AZIMUTH} AS az FROM placed)""",
  f"""placed AS MATERIALIZED (SELECT c.event_id, c.lat, c.lon, c.depth_km, s.stn_idx, s.lat AS s_lat, s.lon AS s_lon, s.dep_km AS stn_dep, s.sc,
  {km('c.lat', 'c.lon', 's.lat', 's.lon')} AS dist_km FROM catalog c CROSS JOIN stations s)"""))
def partials(spark, sf):
    pairs = joins.event_station(v.catalog(spark, sf), v.stations(spark, sf))
    return rounded(traveltime.partials(pairs, STRAIGHT).select("event_id", "stn_idx", "g_lon", "g_lat", "g_dep", "tt"))


@query("grid_travel_times")
def grid_travel_times(spark, sf):
    """First arrivals of a layered crust, its boundaries at the depth quartiles of the catalogue, at every event and station."""
    cat, st = v.catalog(spark, sf), v.stations(spark, sf)
    layers = ranks.nth_values(cat, "depth_km", {f"q{i}": (lambda n, i=i: F.floor((n - 1) * i / 4)) for i in range(5)})
    layers = layers.select(F.explode(F.array(*[F.struct(F.col(f"q{i}").alias("d"), F.lit(3.2 + 0.3 * i).alias("v")) for i in range(5)])).alias("s"))
    layers = layers.select(F.greatest(F.col("s.d") - 5.0, F.lit(0.0)).alias("depth_km"), F.col("s.v").alias("vs")).unionByName(
        st.agg(F.lit(200.0).alias("depth_km"), F.lit(4.6).alias("vs")))
    model = traveltime.grid_model(layers, cat, st, steps=(10.0, 5.0, 1.0))
    return rounded(traveltime.travel_times(joins.event_station(cat, st), model).select("event_id", "stn_idx", "tt"))


# ---- location and relocation -------------------------------------------------------------------

@query("locate_search")
def locate_search(spark, sf):
    obs = locate.observations(v.lags(spark, sf, seq=True), v.stations(spark, sf))
    return rounded(locate.locate_search(v.catalog(spark, sf), obs, STRAIGHT, bottom=3.0, wgs84=False))


@query("locate_lsq")
def locate_lsq(spark, sf):
    obs = locate.observations(v.lags(spark, sf, seq=True), v.stations(spark, sf))
    return rounded(locate.locate_lsq(v.catalog(spark, sf), obs, STRAIGHT, rounds=2, max_iter=5, bottom=3.0, wgs84=False)[0])


@query("excluded_pairs")
def excluded_pairs(spark, sf):
    st = v.stations(spark, sf)
    lags = v.lags(spark, sf, seq=True).withColumn("weight", F.when(F.col("weight") < 0.3, 0.0).otherwise(F.col("weight")))
    return locate.excluded_pairs(lags, st)


Q["excluded_pairs"] = (excluded_pairs, using("lags stations", """SELECT event_id, string_agg((seq + 1) || ':' || a.code || '-' || b.code, ', ' ORDER BY seq) AS note
  FROM lags l JOIN stations a ON a.stn_idx = l.stn_k JOIN stations b ON b.stn_idx = l.stn_l WHERE weight < 0.3e0 GROUP BY event_id"""))


@query("posterior")
def posterior(spark, sf):
    obs = locate.observations(v.lags(spark, sf, seq=True), v.stations(spark, sf))
    return rounded(locate.posterior(v.catalog(spark, sf), obs, STRAIGHT, bottom=3.0, wgs84=False))


@query("build_catalog", using("catalog", f"""SELECT event_id, {r6("CASE WHEN mode = 'GRD' THEN lat + 0.5e0 ELSE lat END")} AS lat, CASE mode WHEN 'GRD' THEN 'LMO' ELSE 'ERR' END AS mode FROM catalog"""))
def build_catalog(spark, sf):
    cat = v.catalog(spark, sf)
    located = cat.where("mode = 'GRD'").withColumns({"lat": F.col("lat") + 0.5, "mode": F.lit("")})
    return rounded(locate.build_catalog(cat, located, "LMO").select("event_id", "lat", "mode"))


@query("select_td")
def select_td(spark, sf):
    return rounded(relocate_plan.select_td(_tdr(spark, sf), 50))


@query("td_normal_equations", using("catalog lags stations", f"""SELECT a, count(*) AS n_blocks, {r6('sum(m22)')} AS m22 FROM
  (SELECT a, b, sum(m22) AS m22 FROM (SELECT eve0 AS a, eve0 AS b, g0 * g0 AS m22 FROM g WHERE t0 UNION ALL SELECT eve1, eve1, g1 * g1 FROM g WHERE t1
  UNION ALL SELECT least(eve0, eve1), greatest(eve0, eve1), -g0 * g1 FROM g WHERE t0 AND t1) GROUP BY a, b) GROUP BY a""",
  TD + ", " + TIMES + """, gz AS MATERIALIZED (SELECT event_id, stn_idx, (depth_km - stn_dep) / sqrt(dist_km * dist_km + (depth_km - stn_dep) * (depth_km - stn_dep)) / 3.5e0 AS z FROM pairs),
  g AS MATERIALIZED (SELECT t.eve0, t.eve1, l0.z - k0.z AS g0, l1.z - k1.z AS g1, c0.mode <> 'REF' AS t0, c1.mode <> 'REF' AS t1 FROM td t
  JOIN gz k0 ON k0.event_id = t.eve0 AND k0.stn_idx = t.stn_k JOIN gz l0 ON l0.event_id = t.eve0 AND l0.stn_idx = t.stn_l
  JOIN gz k1 ON k1.event_id = t.eve1 AND k1.stn_idx = t.stn_k JOIN gz l1 ON l1.event_id = t.eve1 AND l1.stn_idx = t.stn_l
  JOIN catalog c0 ON c0.event_id = t.eve0 JOIN catalog c1 ON c1.event_id = t.eve1)"""))
def td_normal_equations(spark, sf):
    td, cat = cut(_td(spark, sf)), v.catalog(spark, sf)
    state = cat.withColumn("target", ~F.col("mode").isin("REF", "ERR"))
    rows = relocate_plan.td_rows(td, relocate_plan.pair_places(td, v.stations(spark, sf)), state, STRAIGHT, False)
    system = relocate_plan.td_system(rows.withColumn("w", F.lit(1.0)))
    return rounded(system.groupBy("a").agg(F.count("*").alias("n_blocks"), F.sum("m22").alias("m22")))


@query("relocate")
def relocate(spark, sf):
    """All stages and steps, on every pair of a cluster."""
    pairs = joins.differences(v.catalog(spark, sf, order=True), v.lags(spark, sf), wgs84=False)
    td = relocate_plan.model_residual(pairs, v.catalog(spark, sf), v.stations(spark, sf), STRAIGHT, wgs84=False)
    return rounded(relocate_plan.relocate(v.catalog(spark, sf), td, v.stations(spark, sf), STRAIGHT, bottom=3.0, wgs84=False))


# The events that pass are clustered, then differenced; both blocks of SQL read their catalogue by name.
JOB_SQL = f"""kept AS MATERIALIZED (SELECT * FROM catalog WHERE rms <= 0.8e0), {density_sql().replace("catalog", "kept")},
clustered AS MATERIALIZED (SELECT k.* EXCLUDE (cid), d.cid FROM kept k JOIN dbs d USING (event_id)), {TD_RESID.replace("catalog", "clustered")}"""


@query("cluster_job", using("catalog lags stations", f"""SELECT cid, n_events, n_td, {r6('mean_residual')} AS mean_residual FROM (SELECT cid, count(*) AS n_events FROM clustered GROUP BY cid)
  LEFT JOIN (SELECT cid, count(*) AS n_td, avg(residual) AS mean_residual FROM tdr GROUP BY cid) USING (cid)""", JOB_SQL, recursive=True))
def cluster_job(spark, sf):
    cat, td = cluster_plan.cluster_job(
        v.catalog(spark, sf, order=True), v.lags(spark, sf), v.stations(spark, sf), STRAIGHT, eps_km=EPS, min_pts=MIN_PTS, rms_max=0.8, max_km=TD_KM, wgs84=False)
    per = td.groupBy("cid").agg(F.count("*").alias("n_td"), F.avg("residual").alias("mean_residual"))
    return rounded(stats.cluster_sizes(cat).join(per, "cid", "left"))


# The queries of the text formats register themselves.
from . import format_queries  # noqa: E402, F401
