"""Shared operator helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")


def require_unique(df: DataFrame, keys) -> DataFrame:
    """Reject duplicate keys (e.g. two price rows for one symbol and day).

    Runs one bounded check (a partial aggregation, at most one row returned to
    the driver) and returns ``df`` unchanged when the keys are unique.
    """
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {tuple(dup[0][k] for k in keys)} in columns {list(keys)}")
    return df
