"""The registered queries as SQL over the same driver tables."""

from __future__ import annotations

# Views over the driver tables, in the order they build on each other.
VIEWS = {
    "stations": """SELECT CAST(n_nationkey AS INT) AS stn_idx, n_name AS code, 38e0 + (n_nationkey % 5) * 0.5e0 AS lat,
  141e0 + (n_nationkey - n_nationkey % 5) * 0.1e0 AS lon, (500e0 + 100e0 * n_nationkey) / 1000e0 AS dep_km,
  n_nationkey * 0.02e0 AS pc, n_nationkey * 0.034e0 AS sc FROM nation""",
    "catalog": """SELECT o_orderkey AS event_id, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS event_ord,
  o_orderdate AS ts,
  38e0 + (o_custkey % 8) * 0.25e0 + ((o_orderkey * 7919) % 1000) * 0.00006e0 + CASE WHEN o_orderkey % 97 = 0 THEN 5e0 + (o_orderkey % 30000) * 0.001e0 ELSE 0e0 END AS lat,
  141e0 + ((o_custkey % 40) - (o_custkey % 8)) * 0.05e0 + ((o_orderkey * 104729) % 1013) * 0.00006e0 AS lon,
  5e0 + ((o_orderkey * 31) % 400) / 10e0 AS depth_km, ((o_orderkey * 17) % 100) / 50e0 AS err_lat_km,
  ((o_orderkey * 19) % 100) / 50e0 AS err_lon_km, ((o_orderkey * 23) % 100) / 25e0 AS err_dep_km,
  ((o_orderkey * 13) % 1000) / 1000e0 AS rms,
  CASE WHEN o_orderkey % 20 = 3 THEN 'REF' WHEN o_orderkey % 20 = 7 THEN 'ERR' WHEN o_orderstatus = 'F' THEN 'LMO' WHEN o_orderstatus = 'O' THEN 'TRD' ELSE 'GRD' END AS mode,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE CAST(o_custkey % 40 AS INT) + 1 END AS cid FROM orders""",
    "lags": """SELECT l_orderkey AS event_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS seq,
  CAST(least(l_suppkey % 25, l_partkey % 25) AS INT) AS stn_k, CAST(greatest(l_suppkey % 25, l_partkey % 25) AS INT) AS stn_l,
  round((l_discount - 0.05e0) * 100e0 + l_tax * 10e0, 3) AS lag, l_quantity / 50e0 AS weight
  FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25""",
    "catalog_b": """SELECT event_id, event_ord, ts, lat + 0.01e0 AS lat, lon - 0.02e0 AS lon, depth_km + 1e0 AS depth_km, err_lat_km,
  err_lon_km, err_dep_km, rms * 0.5e0 AS rms, 'TRD' AS mode, cid FROM catalog WHERE event_id % 3 = 0""",
    "picks": """SELECT user_id AS event_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'set' END AS op,
  CAST(event_id % 25 AS INT) AS station, CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE 'N' END AS component,
  CASE WHEN event_type = 'view' THEN 'S' ELSE 'P' END AS phase, ts FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "channels": """SELECT CAST(n_nationkey AS INT) AS station, 'Z' AS component, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS channel FROM nation""",
    "waves": """SELECT user_id AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i, ts, value AS y FROM events""",
    # Last state of the pick log.
    "latest": """SELECT event_id, CAST(station AS VARCHAR) AS station, phase, min_by(component, seq) AS component, max_by(ts, seq) AS ts
  FROM picks p WHERE op = 'set' AND seq > coalesce((SELECT max(seq) FROM picks q WHERE q.op = 'remove' AND q.event_id = p.event_id
  AND q.station = p.station AND q.phase = p.phase), -1) GROUP BY 1, 2, 3""",
}


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def km(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin((radians({d}) - radians({b})) / 2), 2), 1e0))) * 12742e0)"
    )


def using(names: str, query: str, extra: str = "", recursive: bool = False) -> str:
    """``query`` after the named views and further WITH clauses."""
    need = names.split()
    if "catalog_b" in need and "catalog" not in need:
        need.insert(0, "catalog")
    if "latest" in need and "picks" not in need:
        need.insert(0, "picks")
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in need]
    if extra:
        parts.append(extra)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {query}"


NUMERIC = ["lat", "lon", "depth_km", "err_lat_km", "err_lon_km", "err_dep_km", "rms", "cid"]
MELT = "melted AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM catalog" for c in NUMERIC) + ")"
INDEX = "(SELECT {by}value, row_number() OVER ({part}ORDER BY value) AS r, count(*) OVER ({win}) AS n FROM {src})"

# Travel time of every event at every station, straight ray at 3.5 km/s.
TIMES = f"""pairs AS MATERIALIZED (SELECT c.event_id, c.cid, s.stn_idx, c.depth_km, s.dep_km AS stn_dep, s.sc,
  {km('c.lat', 'c.lon', 's.lat', 's.lon')} AS dist_km FROM catalog c CROSS JOIN stations s),
times AS MATERIALIZED (SELECT event_id, stn_idx, sqrt(dist_km * dist_km + (depth_km - stn_dep) * (depth_km - stn_dep)) / 3.5e0 + sc AS tt FROM pairs)"""
RESID = f"""{TIMES}, resid AS MATERIALIZED (SELECT l.event_id, l.seq, l.stn_k, l.stn_l, l.lag, l.weight, b.tt - a.tt AS calc, l.lag - (b.tt - a.tt) AS residual
  FROM lags l JOIN times a ON a.event_id = l.event_id AND a.stn_idx = l.stn_k JOIN times b ON b.event_id = l.event_id AND b.stn_idx = l.stn_l)"""
TD_KM = 1.0
TD = f"""ev AS MATERIALIZED (SELECT event_id, event_ord, cid, lat, lon, mode FROM catalog WHERE cid > 0 AND mode <> 'ERR'),
lg AS MATERIALIZED (SELECT l.event_id, l.stn_k, l.stn_l, l.lag, e.event_ord, e.cid, e.lat, e.lon, e.mode FROM lags l JOIN ev e ON e.event_id = l.event_id),
td AS MATERIALIZED (SELECT * FROM (SELECT a.cid, a.event_id AS eve0, b.event_id AS eve1, a.stn_k, a.stn_l, b.lag - a.lag AS td,
  {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dist_km FROM lg a JOIN lg b ON a.cid = b.cid AND a.stn_k = b.stn_k AND a.stn_l = b.stn_l
  AND a.event_ord < b.event_ord WHERE NOT (a.mode = 'REF' AND b.mode = 'REF')) WHERE dist_km < {TD_KM})"""
# Every pair of a cluster, however far apart.
TD_WHOLE = TD.replace(f" WHERE dist_km < {TD_KM}", "")
TD_RESID = f"""{TD}, {TIMES}, calc AS MATERIALIZED (SELECT DISTINCT l.event_id, l.stn_k, l.stn_l, b.tt - a.tt AS calc FROM lags l
  JOIN times a ON a.event_id = l.event_id AND a.stn_idx = l.stn_k JOIN times b ON b.event_id = l.event_id AND b.stn_idx = l.stn_l),
tdr AS MATERIALIZED (SELECT t.*, abs(t.td - (c1.calc - c0.calc)) AS residual FROM td t
  JOIN calc c0 ON c0.event_id = t.eve0 AND c0.stn_k = t.stn_k AND c0.stn_l = t.stn_l
  JOIN calc c1 ON c1.event_id = t.eve1 AND c1.stn_k = t.stn_k AND c1.stn_l = t.stn_l)"""
EPS, MIN_PTS = 1.0, 4
NEAR = "near_{e} AS MATERIALIZED (SELECT * FROM (SELECT a.event_id AS event_a, b.event_id AS event_b, {d} AS dist_km FROM catalog a JOIN catalog b ON b.lat BETWEEN a.lat - {deg} AND a.lat + {deg} AND b.lon BETWEEN a.lon - {deg2} AND a.lon + {deg2} AND a.event_id <> b.event_id) WHERE dist_km <= {eps})"


def near(name: str, eps: float) -> str:
    """All ordered pairs within eps; the box is wide enough for the latitudes of the catalogue (38 to 75)."""
    return NEAR.format(e=name, d=km("a.lat", "a.lon", "b.lat", "b.lon"), deg=eps / 111.0, deg2=eps / 111.0 / 0.25, eps=eps)


def describe() -> str:
    idx = INDEX.format(by='"column", ', part='PARTITION BY "column" ', win='PARTITION BY "column"', src="melted")
    pick = lambda e: f"max(CASE WHEN r = {e} + 1 THEN value END)"
    return using("catalog", f"""SELECT "column", count(*) AS n, {r6('min(value)')} AS min, {r6('max(value)')} AS max, {r6('avg(value)')} AS mean,
  {r6(f"({pick('(n - 1) // 2')} + {pick('n // 2')}) / 2")} AS median, {r6('stddev_pop(value)')} AS sd, {r6(pick('n // 4'))} AS q1,
  {r6(pick('3 * n // 4'))} AS q3, {r6(pick('3 * n // 4') + ' - ' + pick('n // 4'))} AS iqr FROM {idx} GROUP BY "column\"""", MELT)


def histogram(viewer: bool) -> str:
    cols = ["depth_km", "rms", "err_dep_km"]
    melt = "m AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM catalog" for c in cols) + ")"
    if viewer:
        span = """shape AS (SELECT max(CASE WHEN r = floor((n - 1) * 0.02e0) + 1 THEN value END) AS lo,
  max(CASE WHEN r = ceil((n - 1) * 0.98e0) + 1 THEN value END) AS hi, max(n) AS n FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM m))"""
    else:
        span = "shape AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM m)"
    grid = f"""{melt}, {span}, g AS (SELECT *, CAST(least(greatest(ceil(1 + log10(n) / log10(2e0)), 5), 30) AS BIGINT) AS bins FROM shape),
h AS (SELECT lo, hi, bins, (hi - lo) / bins AS w FROM g),
c AS (SELECT "column", CAST(least(floor((least(greatest(value, lo), hi) - lo) / w), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM m, h GROUP BY 1, 2),
f AS (SELECT DISTINCT "column", b.bin FROM m, (SELECT unnest(range(bins)) AS bin FROM h) b)"""
    return using("catalog", f"""SELECT f."column", f.bin, {r6('lo + f.bin * w')} AS bin_lo, {r6('lo + (f.bin + 1) * w')} AS bin_hi, coalesce(c.n, 0) AS n
  FROM f CROSS JOIN h LEFT JOIN c ON c."column" = f."column" AND c.bin = f.bin""", grid)


def density() -> str:
    """Clusters through squares narrower than eps/sqrt(2): all core events of a square belong together."""
    side_lat, side_lon = EPS / 111.2 / 1.45, EPS / 111.2 / 1.45
    return f"""{near('a', EPS)},
core AS MATERIALIZED (SELECT event_a AS event_id FROM near_a GROUP BY 1 HAVING count(*) >= {MIN_PTS}),
sq AS MATERIALIZED (SELECT c.event_id, c.event_ord, CAST(floor(c.lat / {side_lat}) AS BIGINT) * 1000000 + CAST(floor(c.lon / {side_lon}) AS BIGINT) AS sq
  FROM catalog c JOIN core USING (event_id)),
link AS MATERIALIZED (SELECT DISTINCT a.sq AS a, b.sq AS b FROM near_a n JOIN sq a ON a.event_id = n.event_a JOIN sq b ON b.event_id = n.event_b WHERE a.sq <> b.sq),
reach(a, b) AS (SELECT DISTINCT sq, sq FROM sq UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
lab AS MATERIALIZED (SELECT a AS sq, min(b) AS label FROM reach GROUP BY a),
num AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY min(event_ord)) AS cid FROM sq JOIN lab USING (sq) GROUP BY label),
inner_c AS MATERIALIZED (SELECT event_id, cid FROM sq JOIN lab USING (sq) JOIN num USING (label)),
edge_c AS (SELECT n.event_a AS event_id, min(i.cid) AS cid FROM near_a n JOIN inner_c i ON i.event_id = n.event_b WHERE n.event_a NOT IN (SELECT event_id FROM core) GROUP BY 1),
dbs AS MATERIALIZED (SELECT c.event_id, CAST(coalesce(i.cid, e.cid, 0) AS INT) AS cid, i.cid IS NOT NULL AS core FROM catalog c
  LEFT JOIN inner_c i ON i.event_id = c.event_id LEFT JOIN edge_c e ON e.event_id = c.event_id)"""
