import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import series_df
from marketmood.operators import evaluation as EV
from marketmood.operators import filters as FL
from marketmood.operators import rollups as R
from marketmood.operators import text_ops as TO
from marketmood.sources.registry import latest_model


def test_quartiles(spark):
    df = series_df(spark, [1, 2, 4, 8])
    r = R.describe_numeric(df, ["x"]).collect()[0]
    assert r.p25 == 1.75 and r.p50 == 3.0 and r["count"] == 4 and r.min == 1.0 and r.max == 8.0


def test_histogram_bins(spark):
    df = series_df(spark, [0, 1, 2, 3, 4, 10])
    h = {r.bin: r.n for r in R.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 1, 4: 1}
    assert sum(h.values()) == 6


def test_null_counts(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r.column: r.nulls for r in R.null_counts(df, ["x", "s"]).collect()}
    assert got == {"x": 2, "s": 1}


def test_date_range_rejects_empty(spark):
    df = series_df(spark, [1, 2])
    with pytest.raises(ValueError):
        FL.date_range(df, dt.date(2020, 1, 1), dt.date(2020, 1, 1))
    assert FL.date_range(df, dt.date(2020, 1, 1), dt.date(2020, 1, 2)).count() == 2


def test_drop_strict(spark):
    df = series_df(spark, [1])
    with pytest.raises(ValueError):
        FL.drop_strict(df, ["nope"])


def test_latest_model(spark):
    listing = spark.createDataFrame(
        [("TSLA", "/m/TSLA/generator_V_99.h5"), ("TSLA", "/m/TSLA/generator_V_499.h5"),
         ("TSLA", "/m/TSLA/discriminator_V_999.h5"), ("TSLA", "/m/TSLA/generator_V_x.h5")],
        "symbol string, path string")
    r = latest_model(listing).collect()
    assert [(x.symbol, x.path, x.version) for x in r] == [("TSLA", "/m/TSLA/generator_V_499.h5", 499)]


def test_latest_model_from_files(spark, tmp_path):
    for v in (49, 99, 149):
        p = tmp_path / "AAPL" / f"generator_V_{v}.h5"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    from marketmood.sources.registry import list_models
    r = latest_model(list_models(spark, str(tmp_path))).collect()
    assert r[0].symbol == "AAPL" and r[0].version == 149


def test_classification_report(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
    df = spark.createDataFrame(rows, "label long, prediction long")
    rep = {r["class"]: r for r in EV.classification_report(df).collect()}
    assert rep["Negative"].precision == 1.0 and abs(rep["Negative"].recall - 2 / 3) < 1e-12
    assert abs(rep["Neutral"].precision - 1 / 3) < 1e-12 and rep["Neutral"].recall == 1.0
    assert abs(rep["accuracy"].f1 - 4 / 6) < 1e-12 and rep["accuracy"].support == 6


def test_mean_by_target_date(spark):
    df = spark.createDataFrame(
        [("S", [dt.date(2020, 1, 2), dt.date(2020, 1, 3)], [1.0, 3.0]),
         ("S", [dt.date(2020, 1, 3), dt.date(2020, 1, 4)], [5.0, 7.0])],
        "symbol string, y_dates array<date>, pred array<double>")
    got = {r.date.day: r.pred_mean for r in EV.mean_by_target_date(df).collect()}
    assert got == {2: 1.0, 3: 4.0, 4: 7.0}


def test_encode_tokens(spark):
    df = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, [])], "doc_id long, tokens array<string>")
    vocab = TO.build_vocab(df, "tokens", 2)
    assert {r.token: r.id for r in vocab.collect()} == {"a": 4, "b": 5}
    enc = {r.doc_id: r for r in TO.encode_tokens(df, vocab, max_len=6).collect()}
    assert enc[1].input_ids == [2, 4, 5, 1, 3, 0] and enc[1].attention_mask == [1, 1, 1, 1, 1, 0]
    assert enc[2].input_ids == [2, 3, 0, 0, 0, 0]
    enc2 = {r.doc_id: r for r in TO.encode_tokens(df, vocab, max_len=4).collect()}
    assert enc2[1].input_ids == [2, 4, 5, 3]


def test_lemmatise_keeps_order_and_empty(spark):
    df = spark.createDataFrame([(1, ["idiots", "x", "morons"]), (2, [])], "doc_id long, tokens array<string>")
    lem = spark.createDataFrame([("idiots", "idiot"), ("morons", "moron")], "form string, lemma string")
    got = {r.doc_id: r.lemmas for r in TO.lemmatise(df, lem).collect()}
    assert got == {1: ["idiot", "x", "moron"], 2: []}


def test_symbol_list_first_seen(spark):
    a = series_df(spark, [1, 2], "B", 1)
    b = series_df(spark, [1], "A", 1).withColumn("date", F.date_add("date", 1))
    got = [r.symbol for r in R.symbol_list(a.unionByName(b), limit=6).collect()]
    assert got == ["B", "A"]


def test_describe_approx_close_to_exact(spark):
    df = spark.range(0, 10001).select((F.col("id") * 1.0).alias("x"))
    e = R.describe_numeric(df, ["x"]).collect()[0]
    a = R.describe_numeric(df, ["x"], exact=False).collect()[0]
    assert e.p50 == 5000.0 and abs(a.p50 - e.p50) <= 2 and a["count"] == e["count"] == 10001


def test_exact_quantiles_against_numpy(spark):
    import numpy as np
    from marketmood.operators.rollups import exact_quantiles
    rng = np.random.default_rng(5)
    cols = {"a": rng.normal(size=3001), "b": rng.integers(0, 4, 3001).astype(float), "c": np.full(3001, 7.0),
            "d": np.r_[np.zeros(2000), rng.normal(size=1001)]}
    rows = [tuple(None if name == "a" and i % 5 == 0 else float(v[i]) for name, v in cols.items()) + (None,) for i in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    for accuracy in (10_000, 50):
        got, _ = exact_quantiles(df, list("abcde"), probs, accuracy)
        for i, name in enumerate("abcd"):
            want = np.quantile([r[i] for r in rows if r[i] is not None], probs)
            assert np.allclose(got[name], want, rtol=0, atol=1e-9), (name, accuracy)
        assert got["e"] == [None] * 5
    small = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert exact_quantiles(small, ["x"], [0.25, 0.5])[0] == {"x": [1.25, 1.5]}
