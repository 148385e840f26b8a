import datetime as dt
import math

from conftest import col_values, series_df
from marketmood.operators import scaling as SC
from marketmood.operators import sequences as SQ

from pyspark.sql import functions as F


def test_minmax_and_constant(spark):
    a = series_df(spark, [1, 3], "A")
    b = series_df(spark, [5, 5], "B")
    df = a.unionByName(b)
    sc = SC.fit_minmax(df, ["x"])
    out = SC.apply_minmax(df, sc, ["x"]).orderBy("symbol", "date")
    assert [r.x for r in out.collect()] == [-1.0, 1.0, -1.0, -1.0]


def test_scale_invert_identity(spark):
    df = series_df(spark, [3.5, 7.25, -2.0, 11.0])
    sc = SC.fit_minmax(df, ["x"])
    s = SC.apply_minmax(df, sc, ["x"])
    back = SC.invert_minmax(s, sc, "x", "x")
    assert [round(v, 9) for v in col_values(back, "x")] == [3.5, 7.25, -2.0, 11.0]


def test_scale_over_series_matches_table(spark):
    df = series_df(spark, [3.5, 7.25, -2.0, 11.0])
    a = SC.scale_over_series(df, ["x"])
    b = SC.apply_minmax(df, SC.fit_minmax(df, ["x"]), ["x"])
    assert col_values(a, "x") == col_values(b, "x")


def _seq(spark, n):
    df = series_df(spark, list(range(n)))
    return SQ.make_sequences(df, ["x"], "x", 5, 1)


def test_sequence_counts(spark):
    assert _seq(spark, 10).count() == 5
    assert _seq(spark, 6).count() == 1
    assert _seq(spark, 5).count() == 0


def test_sequence_content(spark):
    s = _seq(spark, 8).orderBy("sample").collect()
    assert s[0].x == [[0.0], [1.0], [2.0], [3.0], [4.0]]
    assert s[0].y == [5.0] and s[0].yc == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert s[0].target_date == dt.date(2020, 1, 6)


def test_sequence_keeps_null_slots(spark):
    df = series_df(spark, [0, None, 2, 3, 4, 5])
    s = SQ.make_sequences(df, ["x"], "x", 5, 1).collect()
    assert s[0].x[1] == [None] and s[0].yc[1] is None


def test_split_last(spark):
    s25 = SQ.split_last(_seq(spark, 30), 20)
    assert s25.filter("split = 'test'").count() == 20 and s25.filter("split = 'train'").count() == 5
    s12 = SQ.split_last(_seq(spark, 17), 20)
    assert s12.filter("split = 'test'").count() == 12 and s12.filter("split = 'train'").count() == 0


def test_target_dates_reference_index(spark):
    s = SQ.split_last(_seq(spark, 30), 20)
    exact = SQ.target_dates(s)
    ref = SQ.target_dates(s, reference_index=True)
    assert exact.filter("split = 'train'").count() == 5
    assert ref.filter("split = 'train'").count() == 6


def test_hash_split_exact_and_stable(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    a = SQ.hash_split(df, "k", 0.2, 42)
    assert a.count() == 1003
    assert a.filter("split = 'test'").count() == 201  # ceil(0.2 * 1003)
    b = SQ.hash_split(df.repartition(7), "k", 0.2, 42)
    ta = {r.k for r in a.filter("split = 'test'").collect()}
    tb = {r.k for r in b.filter("split = 'test'").collect()}
    assert ta == tb


def test_hash_split_matches_global_order(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("k").cast("string"))), 1, 15), 16, 10).cast("bigint")
    order = [r.k for r in df.withColumn("h", h).orderBy("h", "k").collect()]
    test = {r.k for r in SQ.hash_split(df, "k", 0.2, 42).filter("split = 'test'").collect()}
    assert test == set(order[:100])


def test_bucketed_sequences_equal_unbucketed(spark):
    from marketmood.sources import fixtures as FX
    p = FX.prices(spark, "/root/testdata/sf0.001")
    a = SQ.make_sequences(p, ["open", "close"], "close", 5, 2)
    b = SQ.make_sequences_bucketed(p, ["open", "close"], "close", 5, 2, F.date_trunc("week", "date"))
    cols = ["symbol", "sample", "start_date", "target_date", "x", "y", "yc", "y_dates"]
    ra = sorted(tuple(str(r[c]) for c in cols) for r in a.collect())
    rb = sorted(tuple(str(r[c]) for c in cols) for r in b.collect())
    assert ra == rb and len(ra) > 0


def test_hash_split_keeps_rows_with_null_and_repeated_keys(spark):
    rows = [(i,) for i in range(30)] + [(None,), (None,), (7,)]
    df = spark.createDataFrame(rows, "k long")
    for share in (0.0, 0.2, 0.5, 1.0):
        out = SQ.hash_split(df, "k", share, 42).collect()
        assert len(out) == len(rows)
        n = sum(r["split"] == "test" for r in out)
        assert 0 <= n - math.ceil(share * len(rows)) <= 1
        assert len({r["split"] for r in out if r["k"] is None}) == 1
    assert SQ.hash_split(df.limit(0), "k").count() == 0
