"""Money, guarded ratios and percentages.

Sums are kept in DECIMAL so they are exact and order-independent at any
scale; ratios are computed in DOUBLE from those exact sums and rounded
once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def dec_sum(c: Column | str) -> Column:
    """Exact sum that is 0 (not NULL) over no rows."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col), F.lit(0).cast(MONEY))


def money(c: Column | str) -> Column:
    """Round an exact amount to cents and expose it as DOUBLE."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 2).cast("double") + F.lit(0.0)


def as_double(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double") + F.lit(0.0)


def ratio(num: Column, den: Column, positive_only: bool = True) -> Column:
    """num/den as a fraction; 0.0 unless den > 0 (or den != 0 when not positive_only)."""
    guard = den > 0 if positive_only else den != 0
    return F.when(guard, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def pct(num: Column, den: Column, positive_only: bool = True, digits: int = 2) -> Column:
    """Percentage rounded to ``digits`` decimals (2 in every report)."""
    return F.round(ratio(num, den, positive_only) * 100.0, digits) + F.lit(0.0)


def frac(num: Column, den: Column, positive_only: bool = True, digits: int = 6) -> Column:
    """Fraction rounded to ``digits`` decimals (stable across engines)."""
    return F.round(ratio(num, den, positive_only), digits) + F.lit(0.0)


def attach_scalar(df, one_row):
    """Attach the columns of a global aggregate (an ``agg`` without grouping,
    hence exactly one row: a proven size bound) to every row of ``df``."""
    return df.join(F.broadcast(one_row), how="cross")
