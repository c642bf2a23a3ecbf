"""Small numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c) -> Column:
    """Half-up rounding to 6 decimals with plain double arithmetic."""
    return F.floor(col(c) * 1e6 + 0.5) / F.lit(1e6)


def residual_weight(r) -> Column:
    """Inverse absolute residual, kept finite at zero."""
    return F.abs(F.lit(1.0) / (col(r) + 1e-10))


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def scaled(c, lo, hi) -> Column:
    """Position of ``c`` in [lo, hi] as 0..1; 0.5 where it has no meaning."""
    c = col(c).cast("double")
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    span = hi - lo
    usable = finite(c) & finite(span) & (span != 0)
    return F.when(usable, F.least(F.greatest((c - lo) / F.when(span != 0, span), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)


def clamp_depth(depth, top, bottom) -> Column:
    top = top if isinstance(top, Column) else F.lit(float(top))
    bottom = bottom if isinstance(bottom, Column) else F.lit(float(bottom))
    return F.greatest(F.least(col(depth), bottom), top)


def settle(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a one-element ``inline``.

    A filter on them then tests the value. Over a plain projection the optimizer would push the
    filter below and copy the whole formula into it, many times over for nested formulas.
    """
    kept = [c for c in df.columns if c not in new]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))
