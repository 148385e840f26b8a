import math

import pytest

from conftest import col_values, series_df
from marketmood.operators import indicators as ind
from pyspark.sql import functions as F


def approx(a, b, tol=1e-9):
    return all((x is None and y is None) or (x is not None and y is not None and abs(x - y) < tol)
               for x, y in zip(a, b)) and len(a) == len(b)


def test_ma7(spark):
    d = series_df(spark, range(10, 18)).withColumn("m", ind.moving_average("x", 7))
    assert col_values(d, "m") == [None] * 6 + [13.0, 14.0]


def test_rolling3_with_null(spark):
    d = series_df(spark, [1, 2, None, 4, 5, 6]).withColumn("m", ind.moving_average("x", 3))
    assert col_values(d, "m") == [None, None, None, None, None, 5.0]


def test_rolling_std(spark):
    d = series_df(spark, [1, 2, 3, 4]).withColumn("s", ind.moving_std("x", 3))
    assert approx(col_values(d, "s"), [None, None, 1.0, 1.0])


@pytest.mark.parametrize("values,expected", [
    ([1, 2, 3], [1.0, 1.5, 2.25]),
    ([1, None, 3], [1.0, 1.0, 7.0 / 3.0]),
    ([None, 2, 4], [None, 2.0, 3.0]),
])
def test_ema_span3_not_adjusted(spark, values, expected):
    d = ind.ema_recursive(series_df(spark, values), "x", span=3, out="e")
    assert approx(col_values(d, "e"), expected)


@pytest.mark.parametrize("values,expected", [
    ([1, 2, 3], [1.0, 1.75, 34.0 / 13.0]),
    ([1, None, 3], [1.0, 1.0, 2.8]),
])
def test_ema_com05_adjusted(spark, values, expected):
    d = ind.ema_adjusted(series_df(spark, values), "x", com=0.5, out="e")
    assert approx(col_values(d, "e"), expected)


def test_ema_long_series_matches_recursion(spark):
    vals = [100 + 10 * math.sin(i / 7.0) + (i % 5) for i in range(1500)]
    vals[37] = None
    vals[38] = None
    d = ind.ema_recursive(series_df(spark, vals), "x", span=26, out="e")
    got = col_values(d, "e")
    a, q = 2 / 27, 25 / 27
    y, g, exp = None, 0, []
    for v in vals:
        g += 1
        if v is None:
            exp.append(y)
            continue
        if y is None:
            y = v
        else:
            w = q ** g
            y = (w * y + a * v) / (w + a)
        g = 0
        exp.append(y)
    assert approx(got, exp, 1e-9)


def test_ema_constant_is_constant(spark):
    d = ind.ema_recursive(series_df(spark, [5.0] * 50), "x", span=12, out="e")
    assert approx(col_values(d, "e"), [5.0] * 50)


def test_forward_fill(spark):
    d = ind.forward_fill(series_df(spark, [None, 5, None, 7]), ["x"])
    assert col_values(d, "x") == [None, 5.0, 5.0, 7.0]


def test_log_return(spark):
    d = series_df(spark, [2, 4, 0]).withColumn("r", ind.log_return("x"))
    assert approx(col_values(d, "r"), [None, math.log(2), None])


def test_bollinger(spark):
    d = ind.bollinger(series_df(spark, [1, 2, 3]), "x", n=3, k=2.0)
    assert approx(col_values(d, "upper_band"), [None, None, 4.0])
    assert approx(col_values(d, "lower_band"), [None, None, 0.0])


def test_macd_of_constant_is_zero(spark):
    d = ind.macd(series_df(spark, [3.0] * 40), "x")
    assert approx(col_values(d, "macd"), [0.0] * 40)


def test_windows_are_per_symbol(spark):
    a = series_df(spark, [1, 2, 3], "A")
    b = series_df(spark, [10, 20, 30], "B")
    d = a.unionByName(b).withColumn("m", ind.moving_average("x", 2))
    got = {(r.symbol, r.date.day): r.m for r in d.collect()}
    assert got[("A", 2)] == 1.5 and got[("B", 1)] is None and got[("B", 3)] == 25.0


def _rows(df, cols):
    return sorted((r["symbol"], r["date"]) + tuple(None if r[c] is None else round(r[c], 8) for c in cols)
                  for r in df.select("symbol", "date", *cols).collect())


def test_bucketed_features_equal_unbucketed(spark):
    from pyspark.sql import functions as F
    from marketmood.sources import fixtures as FX
    p = FX.prices(spark, "/root/testdata/sf0.001").select("symbol", "date", "close")
    base = ind.bollinger(p.withColumn("ma7", ind.moving_average("close", 7))
                         .withColumn("ma20", ind.moving_average("close", 20)), "close", 20, 2.0)
    base = base.withColumn("log_return", ind.log_return("close"))
    cols = ["ma7", "ma20", "upper_band", "lower_band", "log_return"]
    # weekly buckets hold fewer rows than the 19-row lookback: overlap spans several buckets
    weekly = ind.moving_features_bucketed(p, "close", F.date_trunc("week", "date"))
    yearly = ind.moving_features_bucketed(p, "close")
    assert _rows(weekly, cols) == _rows(base, cols) == _rows(yearly, cols)


def test_bucketed_ema_equal_unbucketed(spark):
    from pyspark.sql import functions as F
    from marketmood.sources import fixtures as FX
    p = FX.prices(spark, "/root/testdata/sf0.01").select("symbol", "date", "close")
    alphas = [2 / 13, 2 / 27]
    base = ind.ema_recursive_multi(p, "close", alphas, ["e12", "e26"])
    split = ind.ema_bucketed(p, "close", alphas, ["e12", "e26"], F.date_trunc("month", "date"))
    a = {(r.symbol, r.date): (r.e12, r.e26) for r in base.collect()}
    b = {(r.symbol, r.date): (r.e12, r.e26) for r in split.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k][i] - b[k][i]) <= 1e-9 * abs(a[k][i]) for k in a for i in (0, 1))


@pytest.mark.parametrize("nulls", [False, True])
def test_block_scan_equals_frame_version(spark, nulls):
    vals = [100 + 10 * math.sin(i / 7.0) + (i % 5) for i in range(1500)]
    if nulls:
        for j in (0, 37, 38, 500, 501, 502, 503, 1499):
            vals[j] = None
    df = series_df(spark, vals)
    alphas = [2 / 13, 2 / 27, 0.9]
    a = ind.ema_recursive_multi(df, "x", alphas, ["e1", "e2", "e3"])
    b = ind.ema_block_scan(df, "x", alphas, ["e1", "e2", "e3"])
    for c in ("e1", "e2", "e3"):
        assert approx(col_values(b, c), col_values(a, c), 1e-9)


def test_bucketed_windows_keep_null_keys_and_dates(spark):
    import datetime as dt
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=40 * i), float(i)) for i in range(30)]
    rows += [(None, dt.date(2020, 5, 1) + dt.timedelta(days=i), float(i)) for i in range(25)] + [("A", None, 5.0), (None, None, 6.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r.symbol, r.date): r for r in ind.moving_features_bucketed(df, "close").collect()}
    d = df.withColumn("ma7", ind.moving_average("close", 7)).withColumn("log_return", ind.log_return("close"))
    assert len(got) == len(rows)
    for r in d.collect():
        assert got[(r.symbol, r.date)].ma7 == r.ma7 and got[(r.symbol, r.date)].log_return == r.log_return


def test_bucketed_ema_with_nulls_equals_unbucketed(spark):
    import random
    rng = random.Random(3)
    vals = [None if rng.random() < 0.3 or 200 < i < 320 else rng.uniform(1, 100) for i in range(900)]
    df = series_df(spark, vals)
    a = col_values(ind.ema_recursive_multi(df, "x", [0.3, 2 / 27], ["e", "f"]), "f")
    for bucket in (F.date_trunc("month", "date"), F.year("date")):
        b = col_values(ind.ema_bucketed(df, "x", [0.3, 2 / 27], ["e", "f"], bucket), "f")
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))
