"""Supervised sequences, chronological hold-out and deterministic splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.session import store


def make_sequences(df: DataFrame, features, target: str, length: int = 5, horizon: int = 1,
                   key="symbol", order: str = "date", position: str | None = None,
                   keep=(), date_col: str | None = None) -> DataFrame:
    """One row per window start ``i`` with a full input and target window.

    ``x``: ``length`` rows of all features (array of arrays, row-major),
    ``y``: the next ``horizon`` target values, ``yc``: the target over the input
    window, ``y_dates``: the target dates. Frames are anchored at the window
    start, so each row reads only ``length + horizon`` neighbours; NULLs keep
    their slot because whole rows are collected. ``n - length - horizon + 1``
    samples per series (none when shorter).
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    date_col = date_col or order
    w = Window.partitionBy(*keys).orderBy(order)
    fx = w.rowsBetween(0, length - 1)
    fy = w.rowsBetween(length, length + horizon - 1)
    row = F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    tgt = F.struct(F.col(target).cast("double").alias("v"), F.col(date_col).alias("d"))
    d = (df.withColumn("_xs", F.collect_list(row).over(fx))
         .withColumn("_yc", F.collect_list(tgt).over(fx))
         .withColumn("_ys", F.collect_list(tgt).over(fy))
         .withColumn("sample", ((F.col(position) if position else F.row_number().over(w)) - 1).cast("bigint")))
    d = d.filter((F.size("_xs") == length) & (F.size("_ys") == horizon))
    nf = len(features)
    return d.select(
        keys[0], *keep, "sample", F.col(date_col).alias("start_date"),
        F.element_at(F.col("_ys"), 1)["d"].alias("target_date"),
        F.transform("_xs", lambda s: F.array(*[s[f"f{i}"] for i in range(nf)])).alias("x"),
        F.transform("_ys", lambda s: s["v"]).alias("y"),
        F.transform("_yc", lambda s: s["v"]).alias("yc"),
        F.transform("_ys", lambda s: s["d"]).alias("y_dates"))


def split_last(seq: DataFrame, n_test: int = 20, key: str = "symbol", order: str = "sample",
               out: str = "split") -> DataFrame:
    """The last ``n_test`` samples of each series are ``test``, the rest ``train``.

    A series shorter than ``n_test`` is all test (no wrap-around).
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (seq.withColumn("_rk", F.row_number().over(w))
            .withColumn(out, F.when(F.col("_rk") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("_rk"))


def target_dates(seq: DataFrame, key: str = "symbol", split: str = "split",
                 reference_index: bool = False, horizon: int = 1) -> DataFrame:
    """``(symbol, split, date)`` of the dates each split predicts.

    Exact by default: every sample contributes its own target dates. With
    ``reference_index=True`` the train list also holds the first ``horizon``
    test target dates, like the original positional index.
    """
    exact = seq.select(key, split, F.explode("y_dates").alias("date"))
    if not reference_index:
        return exact.distinct()
    w = Window.partitionBy(key).orderBy("sample")
    extra = (seq.filter(F.col(split) == "test")
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= horizon)
             .select(key, F.lit("train").alias(split), F.col("target_date").alias("date")))
    return exact.unionByName(extra).distinct()


def hash_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, out: str = "split",
               prefix_hex: int = 4) -> DataFrame:
    """M1: deterministic split with exactly ``ceil(test * n)`` test rows.

    Rows are ordered by ``md5(seed:key)``, then the key. The keys alone are
    written to the shared folder; there the last test row is found by counting
    hash prefixes (at most 16^4 counts) and ordering the keys of one prefix.
    Labelling is then a comparison with that row, so ``df`` is read once for its
    keys and once for the result, and nothing but keys is shuffled. Rows that
    share a key, among them those with a NULL key, fall on one side together,
    which may exceed the share by the copies of the last test key.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), text))
    d = store(df.select(hashed.alias("h"), text.alias("k")), "split-keys")
    part = F.substring("h", 1, prefix_hex)
    counts = sorted((r["p"], r["n"]) for r in d.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    need = math.ceil(sum(n for _, n in counts) * test)
    last = None
    for prefix, n in counts:
        if 0 < need <= n:
            top = d.filter(part == prefix).orderBy("h", "k").limit(need)
            last = top.agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
        need -= n
    if last is None:  # no test rows
        return df.withColumn(out, F.lit("train"))
    is_test = (hashed < last["h"]) | ((hashed == last["h"]) & (text <= last["k"]))
    return df.withColumn(out, F.when(is_test, "test").otherwise("train"))


def make_sequences_bucketed(df: DataFrame, features, target: str, length: int = 5, horizon: int = 1,
                            bucket=None, key: str = "symbol", order: str = "date") -> DataFrame:
    """W10 with the series split into time buckets (default: calendar year):
    every bucket gets the ``length + horizon - 1`` rows that follow it, so the
    windows starting in the bucket are complete; runs over ``(key, bucket)``."""
    from marketmood.operators.indicators import bucketed_windows
    bucket = bucket if bucket is not None else F.year(order)

    def compute(frame, w):
        seq = make_sequences(frame, features, target, length, horizon, key=[key, "_bucket"], order="_rn",
                             position="_rn", keep=("_own", "_bucket", "_rn"), date_col=order)
        return seq

    out = bucketed_windows(df, bucket, 0, compute, key, order, lookahead=length + horizon - 1)
    return out
