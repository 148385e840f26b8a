"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def for_symbols(df: DataFrame, symbols, key: str = "symbol") -> DataFrame:
    """keep the listed symbols (an IN predicate, pushed to the scan)."""
    return df.filter(F.col(key).isin(list(symbols)))


def date_range(df: DataFrame, start, end, col: str = "date") -> DataFrame:
    """inclusive ``start <= date <= end``; ``start >= end`` is rejected."""
    if start >= end:
        raise ValueError(f"end date must fall after start date ({start} >= {end})")
    return df.filter(F.col(col).between(F.lit(start), F.lit(end)))


def drop_strict(df: DataFrame, cols) -> DataFrame:
    """drop columns, failing when one is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"cannot drop missing columns {missing}")
    return df.drop(*cols)


def drop_warmup(df: DataFrame, n: int = 20, key: str = "symbol", order: str = "date",
                pos: str = "pos") -> DataFrame:
    """drop the first ``n`` rows per series and renumber from 1."""
    w = Window.partitionBy(key).orderBy(order)
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") > n)
            .withColumn(pos, (F.col("_rn") - n).cast("bigint")).drop("_rn"))


def to_series(df: DataFrame, id_cols, value_cols, var: str = "variable", val: str = "value") -> DataFrame:
    """wide-to-long ``(ids..., variable, value)`` for multi-series charts."""
    return df.unpivot(list(id_cols), list(value_cols), var, val)


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """F8: two-column projection."""
    return df.select(x, y)


def price_series(df: DataFrame, value: str = "close", key: str = "symbol", order: str = "date") -> DataFrame:
    """``(symbol, date, value)`` series."""
    return df.select(key, order, value)
