"""Joins (J1-J4).

Daily tables are keyed by ``(symbol, date)``; AQE decides between broadcast
and sort-merge at run time from the actual sizes, so no side is forced into
a broadcast here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "date"]


def join_daily(sent: DataFrame, prices: DataFrame, keys=KEYS) -> DataFrame:
    """Inner join of daily sentiment and daily prices; unmatched days vanish."""
    return sent.join(prices, list(keys), "inner")


def align_to_dates(df: DataFrame, dates: DataFrame, keys=KEYS) -> DataFrame:
    """Every wanted ``(symbol, date)`` kept, missing values NULL."""
    return dates.select(*keys).join(df, list(keys), "left")


def outer_by_date(a: DataFrame, b: DataFrame, keys=KEYS) -> DataFrame:
    """Full outer join on ``(symbol, date)``."""
    return a.join(b, list(keys), "full")


def prediction_table(pred: DataFrame, prices: DataFrame, start=None, end=None,
                     value: str = "close", keys=KEYS) -> DataFrame:
    """``(symbol, date, real, predicted)`` paired by date (not by position)."""
    out = pred.join(prices.select(*keys, F.col(value).alias("real")), list(keys), "inner")
    if start is not None and end is not None:
        if start >= end:
            raise ValueError("end date must fall after start date")
        out = out.filter(F.col("date").between(F.lit(start), F.lit(end)))
    return out.select(*keys, "real", "predicted")


def head_per_symbol(df: DataFrame, k: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """K3: first ``k`` rows per symbol (planned as a per-group limit)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
