"""Per-symbol min/max scaling.

The scaler is a small long table ``(symbol, feature, data_min, data_max, lo,
hi)`` -- symbols x features rows, independent of the row count. How it is
joined when applied is left to Spark, which broadcasts what is small at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _scale(x: Column, mn: Column, mx: Column, lo: Column, hi: Column) -> Column:
    rng = mx - mn
    factor = (hi - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return (x - mn) * factor + lo


def _unscale(s: Column, mn: Column, mx: Column, lo: Column, hi: Column) -> Column:
    rng = mx - mn
    factor = (hi - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    return (s - lo) / factor + mn


def fit_minmax(df: DataFrame, cols, key: str = "symbol", lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Min and max of every column per symbol (NULLs ignored)."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max")]
    wide = df.groupBy(key).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__min").alias("data_min"),
                     F.col(f"{c}__max").alias("data_max")) for c in cols]
    return (wide.select(key, F.explode(F.array(*rows)).alias("r"))
            .select(key, "r.*", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))


def _wide(scaler: DataFrame, cols, key: str) -> DataFrame:
    aggs = []
    for c in cols:
        m = F.col("feature") == c
        aggs += [F.max(F.when(m, F.col("data_min"))).alias(f"{c}__min"),
                 F.max(F.when(m, F.col("data_max"))).alias(f"{c}__max"),
                 F.max(F.when(m, F.col("lo"))).alias(f"{c}__lo"),
                 F.max(F.when(m, F.col("hi"))).alias(f"{c}__hi")]
    return scaler.groupBy(key).agg(*aggs)


def apply_minmax(df: DataFrame, scaler: DataFrame, cols, key: str = "symbol", suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min) * (hi - lo) + lo``; a constant column maps to ``lo``."""
    w = _wide(scaler, cols, key).withColumnRenamed(key, "_of")
    d = df.join(w, F.col(key).eqNullSafe(F.col("_of")), "left")

    def scaled(c):
        return _scale(F.col(c).cast("double"), F.col(f"{c}__min"), F.col(f"{c}__max"),
                      F.col(f"{c}__lo"), F.col(f"{c}__hi")).alias(c + suffix)

    targets = {c + suffix: c for c in cols}
    keep = [F.col(x) for x in df.columns if x not in targets]
    return d.select(*keep, *[scaled(c) for c in cols])


def invert_minmax(df: DataFrame, scaler: DataFrame, col: str, feature: str, key: str = "symbol",
                  out: str | None = None) -> DataFrame:
    """Map a scaled column back with the scaler row of ``feature``."""
    s = scaler.filter(F.col("feature") == feature).select(
        key, F.col("data_min").alias("_mn"), F.col("data_max").alias("_mx"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    d = df.join(s, key, "left")
    return d.withColumn(out or col, _unscale(F.col(col), F.col("_mn"), F.col("_mx"), F.col("_lo"), F.col("_hi"))) \
            .drop("_mn", "_mx", "_lo", "_hi")


def scale_over_series(df: DataFrame, cols, key: str = "symbol", lo: float = -1.0, hi: float = 1.0,
                      train_mask: Column | None = None) -> DataFrame:
    """N1+N2 in one pass with per-symbol window min/max (no extra shuffle).

    ``train_mask`` restricts the fit to the rows where it is true
    (``fit_on='train'``); by default all rows are used, as in the reference.
    """
    w = Window.partitionBy(key)

    def scaled(c):
        x = F.col(c).cast("double")
        fx = x if train_mask is None else F.when(train_mask, x)
        return _scale(x, F.min(fx).over(w), F.max(fx).over(w), F.lit(float(lo)), F.lit(float(hi))).alias(c)

    cols = list(cols)
    return df.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns]
                     + [scaled(c) for c in cols if c not in df.columns])
