import datetime as dt

from pyspark.sql import functions as F

from conftest import SF0001
from marketmood.operators import ml as ML
from marketmood.operators import scaling as SC
from marketmood.operators import sequences as SQ
from marketmood.plans import pipeline as P
from marketmood.sources import fixtures as FX
from marketmood.sources.readers import load_scaler, read_posts, read_prices, save_scaler, write_posts


def test_posts_csv_round_trip(spark, tmp_path):
    rows = [("2022-09-29 23:41:16+00:00", 'Tesla "up", again\nnew line', "TSLA", "Tesla, Inc."),
            ("2022-09-30 01:00:00+00:00", None, "AAPL", "Apple")]
    raw = spark.createDataFrame(rows, "date string, text string, symbol string, company string")
    path = str(tmp_path / "posts_csv")
    raw.write.option("header", True).option("escape", '"').csv(path)
    back = read_posts(spark, path, multi_line=True).orderBy("symbol").collect()
    assert back[1].text == 'Tesla "up", again\nnew line' and back[0].text is None
    assert back[1].ts.date() == dt.date(2022, 9, 29)


def test_write_posts_partitioned_parquet(spark, tmp_path):
    p = FX.posts(spark, SF0001, with_text=False)
    path = str(tmp_path / "posts_pq")
    write_posts(p, path)
    back = spark.read.parquet(path)
    assert back.count() == p.count() and "symbol" in back.columns


def test_prices_csv(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("date,open,high,low,close,adj_close,volume,symbol\n2021-09-30,1,2,0.5,1.5,1.5,100,TSLA\n")
    r = read_prices(spark, str(path)).collect()[0]
    assert r.date == dt.date(2021, 9, 30) and r.close == 1.5 and r.volume == 100


def test_malformed_lines_are_left_out_or_shown(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("date,open,high,low,close,adj_close,volume,symbol\n2021-09-30,1,2,0.5,1.5,1.5,100,TSLA\n"
                    "2021-10-01,x,2,0.5,1.5,1.5,100,TSLA\nnot a line\n")
    assert read_prices(spark, str(path)).count() == 1
    shown = read_prices(spark, str(path), keep_corrupt=True).collect()
    assert len(shown) == 3 and sum(r["_corrupt_record"] is not None for r in shown) == 2


def test_prices_of_any_date_type_and_repeated_days(spark, tmp_path):
    import pytest
    p = FX.prices(spark, SF0001).withColumn("adj_close", F.col("close"))
    for i, kind in enumerate(("date", "timestamp_ntz", "timestamp", "string")):
        path = str(tmp_path / f"p{i}")
        p.withColumn("date", F.col("date").cast(kind)).write.parquet(path)
        back = read_prices(spark, path, "parquet", unique=True)
        assert {(r.symbol, r.date, r.close) for r in back.collect()} == {(r.symbol, r.date, r.close) for r in p.collect()}
    path = str(tmp_path / "twice")
    p.union(p.limit(1)).write.parquet(path)
    with pytest.raises(ValueError, match="duplicate key"):
        read_prices(spark, path, "parquet", unique=True)


def test_history_of_a_loaded_model_is_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, "good day" if i % 2 else "bad day", i % 2) for i in range(20)], "doc_id long, text string, label int")
    model = ML.fit_sentiment_classifier(df, "text", "label", num_features=64, max_iter=5)
    assert ML.training_history(model).count() > 0
    ML.save_model(model, str(tmp_path / "m"))
    assert ML.training_history(ML.load_model(str(tmp_path / "m"))).collect() == []


def test_scaler_round_trip(spark, tmp_path):
    df = FX.prices(spark, SF0001)
    sc = SC.fit_minmax(df, ["close", "volume"])
    path = str(tmp_path / "scaler")
    save_scaler(sc, path)
    back = load_scaler(spark, path)
    a = sorted(tuple(r) for r in sc.collect())
    b = sorted(tuple(r) for r in back.select(*sc.columns).collect())
    assert a == b


def test_classifier_save_load_predict(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    lab = docs.withColumn("label", (F.col("doc_id") % 3).cast("bigint"))
    model = ML.fit_sentiment_classifier(lab, max_iter=5, num_features=1 << 12)
    path = str(tmp_path / "clf")
    ML.save_model(model, path)
    again = ML.load_model(path)
    a = ML.predict_sentiment(docs, model).orderBy("doc_id").select("prediction").collect()
    b = ML.predict_sentiment(docs, again).orderBy("doc_id").select("prediction").collect()
    assert a == b and len(a) == docs.count()
    hist = ML.training_history(model).collect()
    assert len(hist) >= 1 and hist[0].iteration == 0


def test_forecaster_recovers_linear_rule(spark):
    # y = 2 * last value of the window + 1: the ridge fit must reproduce it
    rows = []
    for s in ("A", "B"):
        for i in range(60):
            x = [[float((i + j) % 7)] for j in range(5)]
            rows.append((s, i, x, [2.0 * x[-1][0] + 1.0], "train"))
    seq = spark.createDataFrame(rows, "symbol string, sample long, x array<array<double>>, y array<double>, split string")
    coefs = ML.fit_forecaster(seq, ridge=1e-9)
    pred = ML.forecast(seq, coefs)
    err = pred.select(F.max(F.abs(F.col("pred")[0] - F.col("y")[0]))).collect()[0][0]
    assert err < 1e-6


def test_build_dataset_shapes(spark):
    seq = P.build_dataset(spark, SF0001)
    r = seq.first()
    assert len(r.x) == 5 and len(r.x[0]) == len(P.FEATURES) and len(r.y) == 1 and len(r.yc) == 5
    per = {x.symbol: x.n for x in seq.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    test = {x.symbol: x.n for x in seq.filter("split = 'test'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(test[s] == min(20, per[s]) for s in per)
    vals = seq.select(F.explode(F.flatten("x")).alias("v")).agg(F.min("v"), F.max("v")).collect()[0]
    assert vals[0] >= -1.0 - 1e-12 and vals[1] <= 1.0 + 1e-12


def test_persistence_and_split_disjoint(spark):
    seq = SQ.split_last(SQ.make_sequences(FX.prices(spark, SF0001), ["close"], "close"), 20)
    tr = {(r.symbol, r.sample) for r in seq.filter("split = 'train'").collect()}
    te = {(r.symbol, r.sample) for r in seq.filter("split = 'test'").collect()}
    assert not (tr & te) and len(tr) + len(te) == seq.count()


def test_fit_on_train_scales_test_rows_outside_range(spark):
    a = P.build_dataset(spark, SF0001)
    b = P.build_dataset(spark, SF0001, fit_on="train")
    assert a.count() == b.count()
    tr = b.filter("split = 'train'").select(F.explode(F.flatten("x")).alias("v")).agg(F.min("v"), F.max("v")).collect()[0]
    assert tr[0] >= -1.0 - 1e-12 and tr[1] <= 1.0 + 1e-12
    diff = (a.alias("a").join(b.alias("b"), ["symbol", "sample"])
            .filter(F.col("a.y")[0] != F.col("b.y")[0]).count())
    assert diff > 0


def test_require_unique(spark):
    import pytest
    from marketmood.operators.common import require_unique
    ok = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, d int")
    assert require_unique(ok, ["symbol", "d"]) is ok
    bad = spark.createDataFrame([("A", 1), ("A", 1)], "symbol string, d int")
    with pytest.raises(ValueError):
        require_unique(bad, ["symbol", "d"])


def test_classifier_reads_its_texts_once_and_sums_on_the_cluster(spark):
    """Each text was tokenised for IDF, moments and blocks apart, and the driver got several gradients an evaluation."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    rows = [(i, ["good words here", "bad words there", "plain words"][i % 3], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label long").repartition(5)
    model = ML.fit_sentiment_classifier(df.withColumn("text", noted.asNondeterministic()("text")), num_features=1 << 12, max_iter=20)
    assert seen.value == 60
    assert [r.prediction for r in ML.predict_sentiment(df, model).orderBy("doc_id").collect()] == [r[2] for r in rows]
    for splits in (1, 28, 200, 5000):
        parts, depth = ML._tree_shape(splits)
        assert parts * 4 >= splits
        scale, left = 1, parts  # the levels that Spark makes of them
        while scale ** depth < parts:
            scale += 1
        while left > scale + -(-left // scale):
            left //= scale
        assert left == 1
    assert model.stages[-1].getAggregationDepth() == ML._tree_shape(1)[1]


def test_posts_are_written_compressed_and_unsorted(spark, tmp_path):
    rows = [(f"2022-09-{i % 28 + 1:02d} 01:00:00+00:00", f'"line {i}"\nand, another', "ABC"[i % 3], "c") for i in range(90)]
    posts = spark.createDataFrame(rows, "date string, text string, symbol string, company string").coalesce(1)
    path = str(tmp_path / "csv")
    write_posts(posts, path, fmt="csv", partition_by=None, compression="gzip")
    assert [f.name for f in (tmp_path / "csv").glob("part-*")] == [f.name for f in (tmp_path / "csv").glob("*.csv.gz")]
    assert sorted(r.text for r in read_posts(spark, path).collect()) == sorted(r[1] for r in rows)
    write_posts(posts, str(tmp_path / "pq"), compression="zstd")
    assert len(list((tmp_path / "pq").glob("symbol=*/*.zstd.parquet"))) == 3
    back = spark.read.parquet(str(tmp_path / "pq")).select("date", "text", "symbol", "company")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
