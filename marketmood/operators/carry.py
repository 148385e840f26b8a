"""Whole-series steps on series of any length: positions, last values and hold-outs by a two-level carry.

A window over a whole series runs in one task. Here a series is cut into buckets
that follow its order (e.g. ``F.year("date")``). First each bucket is reduced to
its row count and last present values (partial aggregation, one small row a
bucket); a prefix over the buckets of a series gives what each bucket starts
with; then windows run inside the buckets, in parallel, and take up that start.
The input is read twice, so a costly one should be stored first. NULL keys and
NULL order values form series and buckets of their own, and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.functions.numeric import present
from marketmood.operators.indicators import KEY, ORDER, _null_safe_join


def carried(df: DataFrame, bucket: Column | None = None, last_of=(), key: str = KEY, order: str = ORDER) -> DataFrame:
    """``df`` with ``_pos`` (1-based position in its series), ``_n`` (rows of the series) and ``_last_<c>``.

    ``_last_<c>`` is the last present value of column c up to and with the row.
    ``order`` values of a series should differ; rows with equal ones share a
    bucket and are put in some order. ``bucket`` (default: the calendar year)
    must not fall while ``order`` rises.
    """
    d = df.withColumn("_bucket", F.year(order) if bucket is None else bucket)
    last = {c: F.max(F.when(present(df, c).isNotNull(), F.struct(F.col(order).alias("o"), present(df, c).alias("v"))))
            for c in last_of}
    sums = d.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"), *[x.alias(f"_end_{c}") for c, x in last.items()])
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_bucket", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                       F.sum("_cnt").over(Window.partitionBy(key)).alias("_n"),
                       *[F.last(F.col(f"_end_{c}")["v"], ignorenulls=True).over(before).alias(f"_start_{c}") for c in last_of])
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", F.row_number().over(inside).alias("_lrn"),
                     *[F.last(present(df, c), ignorenulls=True).over(upto).alias(f"_own_{c}") for c in last_of])
    out = _null_safe_join(local, sums, [key, "_bucket"])
    return out.select(*[F.col(c) for c in df.columns], (F.col("_off") + F.col("_lrn")).alias("_pos"), "_n",
                      *[F.coalesce(f"_own_{c}", f"_start_{c}").alias(f"_last_{c}") for c in last_of])


def with_position_carried(df: DataFrame, out: str = "pos", bucket: Column | None = None, key: str = KEY,
                          order: str = ORDER) -> DataFrame:
    """As ``with_position``, bucket by bucket."""
    return carried(df, bucket, (), key, order).withColumn(out, F.col("_pos").cast("bigint")).drop("_pos", "_n")


def forward_fill_carried(df: DataFrame, cols, bucket: Column | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """As ``forward_fill``, bucket by bucket; a gap over whole buckets is filled from the bucket before it."""
    cols = list(cols)
    d = carried(df, bucket, cols, key, order)
    return d.select(*[F.col(f"_last_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_warmup_carried(df: DataFrame, n: int = 20, bucket: Column | None = None, key: str = KEY, order: str = ORDER,
                        pos: str = "pos") -> DataFrame:
    """as ``drop_warmup``, bucket by bucket."""
    d = carried(df, bucket, (), key, order).filter(F.col("_pos") > n)
    return d.withColumn(pos, (F.col("_pos") - n).cast("bigint")).drop("_pos", "_n")


def split_last_carried(seq: DataFrame, n_test: int = 20, bucket: Column | None = None, key: str = KEY, order: str = "sample",
                       out: str = "split", bucket_rows: int = 100_000) -> DataFrame:
    """As ``split_last``, bucket by bucket; buckets default to ranges of ``bucket_rows`` sample numbers."""
    bucket = F.floor(F.col(order) / bucket_rows) if bucket is None else bucket
    d = carried(seq, bucket, (), key, order)
    return d.withColumn(out, F.when(F.col("_pos") > F.col("_n") - n_test, F.lit("test")).otherwise(F.lit("train"))).drop("_pos", "_n")
