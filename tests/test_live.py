import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from marketmood.operators.sentiment import score_sentiment
from marketmood.sources import fixtures as FX
from marketmood.streaming import live as LV

SCHEMA = "ts timestamp, symbol string, text string"
DAY = dt.datetime(2024, 3, 1, 12)


def post(day, symbol, text, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour), symbol, text


FILES = [
    [post(0, "A", "best worthless best!"), post(0, "B", None), post(9, "A", "not best"), post(9, "A", "clown")],
    [post(9, "A", "best ever", 3), post(1, "B", "very best but trash"), post(20, "A", "BEST of all, no idiot")],
    [post(0, "A", "late stupid post", -2), post(20, "A", ""), post(30, "B", "best"), post(0, "B", "best")],  # weeks late
]


def write(spark, folder, i):
    spark.createDataFrame(FILES[i], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.createDataFrame([r for f in FILES[:i + 1] for r in f], SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def want(spark, posts):
    posts = posts.withColumn("doc_id", F.monotonically_increasing_id())
    scores = score_sentiment(posts, "text", "doc_id", FX.lexicon(spark))
    rows = posts.join(scores, "doc_id").groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.avg("compound").alias("compound"), F.count(F.lit(1)).alias("n_posts"))
    return sorted((r.symbol, r.date, None if r.compound is None else round(r.compound, 9), r.n_posts) for r in rows.collect())


def got(live):
    return sorted((r.symbol, r.date, None if r.compound is None else round(r.compound, 9), r.n_posts)
                  for r in LV.sentiment_of(live.table()).collect())


def sentiment(spark, folder):
    return LV.LiveTable(spark, f"{folder}/live", LV.sentiment_parts(FX.lexicon(spark)), LV.merge_sentiment_parts)


def test_restarts_late_rows_and_open_days(spark, tmp_path):
    assert sentiment(spark, tmp_path).table() is None
    sentiment(spark, tmp_path).compact()
    for i in range(len(FILES)):
        posts = write(spark, tmp_path, i)
        live = sentiment(spark, tmp_path).run(stream(spark, tmp_path))  # a new query each time
        assert got(live) == want(spark, posts)
        if i != 1:
            live.compact()
            assert got(sentiment(spark, tmp_path)) == want(spark, posts)
    live.compact()
    assert got(live.run(stream(spark, tmp_path))) == want(spark, posts)  # nothing new


def test_a_batch_that_failed_after_writing_counts_once(spark, tmp_path):
    posts = write(spark, tmp_path, 0)
    live = sentiment(spark, tmp_path)
    parts = live.parts

    class Stop(Exception):
        pass

    def written_then_lost(rows):
        out = parts(rows)
        out.write.mode("overwrite").parquet(f"{tmp_path}/live/parts/batch=0")
        raise Stop

    live.parts = written_then_lost
    with pytest.raises(StreamingQueryException):
        live.run(stream(spark, tmp_path))
    live.parts = parts
    assert got(live.run(stream(spark, tmp_path))) == want(spark, posts)


def test_a_stop_while_merging_leaves_the_table(spark, tmp_path):
    for i in range(2):
        posts = write(spark, tmp_path, i)
        live = sentiment(spark, tmp_path).run(stream(spark, tmp_path))
    live.merge(live._current()).limit(1).write.parquet(f"{tmp_path}/live/merged/upto=1")  # not finished
    assert got(live) == want(spark, posts)
    live.compact()
    assert got(live) == want(spark, posts)


def test_bars_of_several_batches(spark, tmp_path):
    rows = [(DAY + dt.timedelta(hours=h), "A", float(p)) for h, p in ((0, 5), (5, 9), (-3, 2), (5, 7), (-3, 4), (30, 1))]
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, "ts timestamp, k string, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    live = LV.LiveTable(spark, f"{tmp_path}/live", LV.bar_parts("ts", "k", "v"), LV.merge_bar_parts).run(s)
    bars = sorted(tuple(r) for r in LV.bars_of(live.table()).collect())
    assert bars == [("A", dt.date(2024, 3, 1), 2.0, 9.0, 2.0, 9.0, 5), ("A", dt.date(2024, 3, 2), 1.0, 1.0, 1.0, 1.0, 1)]


def test_texts_that_posts_name_are_scored_once_a_batch(spark, tmp_path):
    texts = spark.createDataFrame([(0, "best worthless best!"), (1, None), (2, "not best"), (None, "clown")],
                                  "doc_id long, text string")
    rows = [(DAY + dt.timedelta(days=i % 3), "AB"[i % 2], i % 4 if i % 5 else None) for i in range(60)]
    posts = spark.createDataFrame(rows, "ts timestamp, symbol string, doc_id long")
    posts.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    found = spark.readStream.schema(posts.schema).parquet(f"{tmp_path}/in/*")
    live = LV.LiveTable(spark, f"{tmp_path}/live", LV.sentiment_parts(FX.lexicon(spark), texts=texts), LV.merge_sentiment_parts)
    whole = spark.createDataFrame(posts.join(texts, "doc_id").select("ts", "symbol", "text").collect(), SCHEMA)
    assert got(live.run(found)) == want(spark, whole)
