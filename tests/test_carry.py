import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketmood.operators import carry as CA
from marketmood.operators import filters as FL
from marketmood.operators import indicators as ind
from marketmood.operators import sequences as SQ

DAY0 = dt.date(2010, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """One symbol with 99 % of the rows, gaps over whole buckets, NaN, a short series and rows without a symbol."""
    rng = random.Random(7)
    value = lambda i: None if 400 <= i < 900 or rng.random() < 0.3 else float("nan") if rng.random() < 0.1 else rng.random()
    rows = [("HOT", DAY0 + dt.timedelta(days=i), value(i), float(i)) for i in range(3000)]
    rows += [("B", DAY0 + dt.timedelta(days=40 * i), value(i), 1.0) for i in range(9)]
    rows += [(None, DAY0 + dt.timedelta(days=100 * i), value(i), 2.0) for i in range(8)]
    return spark.createDataFrame(rows, "symbol string, date date, x double, y double").repartition(6).cache()


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


BUCKETS = {"year": lambda: F.year("date"), "month": lambda: F.date_trunc("month", "date"), "one": lambda: F.lit(1), "default": lambda: None}


@pytest.mark.parametrize("name", BUCKETS)
def test_carried_steps_equal_the_unsplit_ones(spark, hot, name):
    bucket = BUCKETS[name]
    assert rows(CA.with_position_carried(hot, "pos", bucket())) == rows(ind.with_position(hot))
    assert rows(CA.forward_fill_carried(hot, ["x"], bucket())) == rows(ind.forward_fill(hot, ["x"]))
    assert rows(CA.drop_warmup_carried(hot, 20, bucket())) == rows(FL.drop_warmup(hot, 20))
    assert rows(CA.split_last_carried(hot, 25, F.year("date") if bucket() is None else bucket(), order="date")) == rows(SQ.split_last(hot, 25, order="date"))


def test_split_of_samples_and_empty_tables(spark, hot):
    seq = ind.with_position(hot, "sample").select("symbol", "sample")
    assert rows(CA.split_last_carried(seq, 20, bucket_rows=64)) == rows(SQ.split_last(seq, 20))
    none = hot.limit(0)
    assert CA.forward_fill_carried(none, ["x"]).count() == CA.drop_warmup_carried(none).count() == 0


def test_a_hot_series_runs_in_many_tasks(spark, hot):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = CA.forward_fill_carried(hot.filter("symbol = 'HOT'"), ["x"], F.date_trunc("month", "date"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 3000 and len(sizes) >= 6 and max(sizes) < 1500


def test_bucketed_indicators_equal_the_unsplit_ones(spark, hot):
    df = hot.withColumn("close", F.when(F.isnan("x"), None).otherwise(F.col("x") + 2.0)).drop("x")
    want = {(r.symbol, r.date): r for r in ind.technical_indicators(df, "close", ema_method="frame").collect()}
    got = {(r.symbol, r.date): r for r in ind.technical_indicators_bucketed(df, "close").collect()}
    assert got.keys() == want.keys()
    for k, a in want.items():
        for c in ("ma7", "ma20", "macd", "upper_band", "lower_band", "ema", "log_momentum"):
            assert (a[c] is None) == (got[k][c] is None) and (a[c] is None or abs(a[c] - got[k][c]) < 1e-9), (k, c)
    one = {(r.symbol, r.date): r.e for r in ind.ema_adjusted(df, "close", com=0.5, out="e").collect()}
    two = {(r.symbol, r.date): r.e for r in ind.ema_adjusted_bucketed(df, "close", com=0.5, out="e").collect()}
    assert one.keys() == two.keys() and all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-12) for k in one)
