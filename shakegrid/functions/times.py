"""Time strings and mode names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .measure import col

# Solver abbreviations and their display names.
MODES = {
    "GRD": "Grid Search",
    "LMO": "Levenberg-Marquardt",
    "MCMC": "MCMC",
    "DE": "Differential Evolution",
    "CLS": "Spatial Clustering (DBSCAN)",
    "TRD": "Triple Difference",
    "SYN": "Create Synthetic data",
}

COMPACT = r"^(\d{2})(\d{2})(\d{2})\.(\d{2})(\d{2})(\d{2})$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})"


def to_iso(c) -> Column:
    """``yyMMdd.HHmmss`` -> ISO; ISO and unknown strings pass through; null -> ''."""
    c = F.coalesce(col(c), F.lit(""))
    part = [F.regexp_extract(c, COMPACT, i) for i in range(1, 7)]
    century = F.when(part[0] < "50", "20").otherwise("19")
    iso = F.concat(
        century, F.concat_ws("-", *part[:3]), F.lit("T"), F.concat_ws(":", *part[3:])
    )
    return F.when(c.rlike(COMPACT), iso).otherwise(c)


def to_compact(c) -> Column:
    """ISO -> ``yyMMdd.HHmmss`` without the fraction; compact and unknown strings pass through."""
    c = F.coalesce(col(c), F.lit(""))
    part = [F.regexp_extract(c, ISO, i) for i in range(1, 7)]
    year = part[0].try_cast("int")
    yy = F.when(year >= 2000, year - 2000).otherwise(year - 1900)
    yy = F.lpad(F.least(F.greatest(yy, F.lit(0)), F.lit(99)).cast("string"), 2, "0")
    return F.when(
        c.rlike(ISO), F.concat(yy, part[1], part[2], F.lit("."), part[3], part[4], part[5])
    ).otherwise(c)


def minute_key(c) -> Column:
    """ISO time cut to the minute."""
    return F.substring_index(to_iso(c), ":", 2)


def time_from_filename(c) -> Column:
    """Event time held in a file name: compact form, else a 14-digit run, else ''."""
    compact = F.regexp_extract(col(c), r"(\d{6}\.\d{6})", 1)
    run = F.regexp_extract(col(c), r"(\d{14})", 1)
    return (
        F.when(compact != "", compact)
        .when(run != "", F.concat(F.substring(run, 3, 6), F.lit("."), F.substring(run, 9, 6)))
        .otherwise("")
    )


def mode_code(c) -> Column:
    """Display name or abbreviation in any case -> abbreviation; others unchanged."""
    c = col(c)
    pairs = [F.lit(x) for code, name in MODES.items() for x in (name, code)]
    return F.when(F.upper(c).isin(*MODES), F.upper(c)).otherwise(
        F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
    )


def mode_name(c) -> Column:
    """Abbreviation in any case -> display name; others unchanged."""
    c = col(c)
    pairs = [F.lit(x) for item in MODES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(c)), c)
