"""Numeric helpers (D-5, D-6) and engine-neutral rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in plain double arithmetic.

    Used by reports that are compared across engines: the formula gives the
    same double in any IEEE engine, unlike decimal-based ROUND variants.
    """
    scale = float(10 ** digits)
    return (F.floor(_c(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def safe_ln(c) -> Column:
    """ln(x) for x > 0, NULL otherwise (no NaN / -inf)."""
    x = _c(c)
    return F.when(x > 0, F.ln(x))


def present(df: DataFrame, c: str) -> Column:
    """The column with NaN read as NULL, as pandas counts NaN as missing."""
    x = F.col(c)
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))


def argmax(scores) -> Column:
    """D-6: 0-based position of the largest element of an array column."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("bigint")
