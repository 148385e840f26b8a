"""Composed plans: scored posts, daily features, the full feature dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.functions.dates import day_of
from marketmood.operators import carry
from marketmood.operators import indicators as ind
from marketmood.operators.joins import join_daily
from marketmood.operators.sentiment import score_in_row, score_sentiment
from marketmood.operators.text_ops import lemmatise
from marketmood.session import store
from marketmood.sources import fixtures
from marketmood.sources.readers import read_text_table


def document_scores(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None) -> DataFrame:
    """Score every document once: ``(doc_id, neg, neu, pos, compound)``.

    The demo lexicon is carried in the rows' expression; a table is joined.
    """
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    if lex is None:
        return score_in_row(docs, "text", dict(fixtures.DEMO_LEXICON)).drop("text")
    return score_sentiment(docs, "text", "doc_id", lex)


def scored_posts(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None) -> DataFrame:
    """Posts with the compound score of the document they mention.

    Posts never carry text: the join moves one small score row per document.
    """
    p = fixtures.posts(spark, sf_dir, with_text=False)
    s = document_scores(spark, sf_dir, lex).select("doc_id", "compound")
    return p.join(s, "doc_id").select("post_id", "ts", "symbol", "doc_id", "compound")


def cleaned_documents(spark: SparkSession, sf_dir: str, lemmas: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text, cleaned_text, text_length)``: URLs out, tokens, stop words out, lemmas, symbols out."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    kept = docs.select("doc_id", TX.drop_stopwords(TX.word_tokens(TX.strip_urls("text"))).alias("tokens"))
    lem = lemmatise(kept, lemmas if lemmas is not None else fixtures.lemmas(spark), "doc_id", "tokens", "tokens")
    cleaned = F.array_join(F.transform("tokens", lambda t: F.regexp_replace(t, TX.NON_WORD_PATTERN, "")), " ")
    return docs.join(lem.select("doc_id", cleaned.alias("cleaned_text")), "doc_id").select(
        "doc_id", "text", "cleaned_text", TX.text_length("text").alias("text_length"))


def scored_posts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of scored posts as it is written: date, text, symbol, company, cleaned text, length, score."""
    scores = document_scores(spark, sf_dir).select("doc_id", "compound")
    docs = cleaned_documents(spark, sf_dir).join(scores, "doc_id")
    posts = fixtures.posts(spark, sf_dir, with_text=False)
    return posts.join(docs, "doc_id").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("date"), "text", "symbol",
        F.col("doc_id").cast("string").alias("company"), "cleaned_text", "text_length", "compound")


def daily_sentiment(posts: DataFrame, score: str = "compound") -> DataFrame:
    """A1 restricted to the score: mean per (symbol, day)."""
    return posts.groupBy("symbol", day_of(posts, "ts").alias("date")).agg(F.avg(score).alias(score))


def daily_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, date)`` of the joined daily table, without scoring any text."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id")
    posts = fixtures.posts(spark, sf_dir, with_text=False).join(docs, "doc_id", "left_semi")
    days = posts.select("symbol", day_of(posts, "ts").alias("date")).distinct()
    return days.join(fixtures.prices(spark, sf_dir).select("symbol", "date"), ["symbol", "date"])


def daily_features(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None) -> DataFrame:
    """Minimum slice: sentiment + prices joined per day with MA7/MA20, Bollinger, log return."""
    sent = daily_sentiment(scored_posts(spark, sf_dir, lex))
    joined = join_daily(sent, fixtures.prices(spark, sf_dir))
    d = (joined.withColumn("ma7", ind.moving_average("close", 7))
         .withColumn("ma20", ind.moving_average("close", 20)))
    d = ind.bollinger(d, "close", 20, 2.0)
    d = d.withColumn("log_return", ind.log_return("close"))
    return d.select("symbol", "date", "compound", "close", "ma7", "ma20",
                    "upper_band", "lower_band", "log_return")


def feature_table(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None,
                  keep_std: bool = False, ema_method: str = "block", bucket: Column | None = None) -> DataFrame:
    """Daily feature rows of the forecaster (before warm-up drop and scaling).

    Columns: ``symbol, date, compound, open, close, high, low, volume, ma7,
    ma20, macd, upper_band, lower_band, ema, log_momentum``.
    """
    sent = daily_sentiment(scored_posts(spark, sf_dir, lex))
    joined = join_daily(sent, fixtures.prices(spark, sf_dir))
    if bucket is not None:
        return ind.technical_indicators_bucketed(joined, "close", bucket, keep_std=keep_std)
    return ind.technical_indicators(joined, "close", keep_std=keep_std, ema_method=ema_method)


# Feature order of the forecaster's input rows.
FEATURES = ["compound", "open", "close", "high", "low", "volume", "ma7", "ma20", "macd",
            "upper_band", "lower_band", "ema", "log_momentum"]


def prepared_series(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None,
                    warmup: int = 20, features=None, ema_method: str = "block", bucket: Column | None = None) -> DataFrame:
    """M9 first half: indicators -> warm-up drop (F5) -> forward fill (W9), unscaled.

    The dataset only uses the EMAs after min/max scaling, so the O(rows) block
    scan is the default here. With ``bucket`` (see :func:`build_dataset`) no
    step has a whole series in one task.
    """
    from marketmood.operators.filters import drop_warmup
    features = features or FEATURES
    d = feature_table(spark, sf_dir, lex, ema_method=ema_method, bucket=bucket)
    if bucket is None:
        d = ind.forward_fill(drop_warmup(d, warmup), features)
    else:
        d = carry.drop_warmup_carried(store(d, "features"), warmup, bucket)
        d = carry.forward_fill_carried(store(d, "warm-features"), features, bucket)
    return d.withColumn("target", F.col("close"))


def build_dataset(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None,
                  length: int = 5, horizon: int = 1, n_test: int = 20, warmup: int = 20,
                  features=None, fit_on: str = "all", bucket: Column | None = None) -> DataFrame:
    """M9: the supervised dataset of every symbol.

    J1 -> W1..W7 -> F5 -> W9 -> N1/N2/N3 (per-symbol min/max over all rows as in
    the reference, or over training rows only with ``fit_on="train"``; range
    (-1, 1)) -> W10 -> W11. Rows: ``symbol, sample, start_date,
    target_date, x, y, yc, y_dates, split``. All window steps are partitioned by
    symbol over a daily series, so they share one exchange. For long series
    (intraday bars, one symbol with most rows) give a ``bucket`` that follows the
    date, e.g. ``F.year("date")``: every step then runs by symbol and bucket.
    """
    return dataset_of(prepared_series(spark, sf_dir, lex, warmup, features, bucket=bucket), length, horizon, n_test,
                      features, fit_on, bucket)


def dataset_of(d: DataFrame, length: int = 5, horizon: int = 1, n_test: int = 20, features=None,
               fit_on: str = "all", bucket: Column | None = None) -> DataFrame:
    """Second half of M9: scale a prepared series, cut sequences, split off the last samples.

    The series is written once; its extremes are an aggregate joined back.
    """
    from marketmood.operators.scaling import apply_minmax, fit_minmax
    from marketmood.operators.sequences import make_sequences, make_sequences_bucketed, split_last
    features = features or FEATURES
    d = store(d, "prepared-series")
    fitted = d
    if fit_on == "train":
        # rows touched by training samples only: positions up to
        # n_train + length + horizon - 1, n_train = samples - min(n_test, samples)
        samples = F.greatest(F.count(F.lit(1)) - length - horizon + 1, F.lit(0))
        last = d.groupBy(F.col("symbol").alias("_of")).agg(
            (samples - F.least(samples, F.lit(n_test)) + length + horizon - 1).alias("_to"))
        fitted = d.join(last, F.col("symbol").eqNullSafe(F.col("_of"))).filter(F.col("pos") <= F.col("_to"))
    elif fit_on != "all":
        raise ValueError("fit_on must be 'all' or 'train'")
    d = apply_minmax(d, fit_minmax(fitted, features + ["target"]), features + ["target"])
    if bucket is None:
        return split_last(make_sequences(d, features, "target", length, horizon), n_test)
    seq = make_sequences_bucketed(d, features, "target", length, horizon, bucket)
    return carry.split_last_carried(store(seq, "sequences"), n_test)


def scaler_of(d: DataFrame, features=None) -> DataFrame:
    """N1 table of a prepared series."""
    from marketmood.operators.scaling import fit_minmax
    return fit_minmax(d, (features or FEATURES) + ["target"])


def dataset_scaler(spark: SparkSession, sf_dir: str, lex: DataFrame | None = None,
                   warmup: int = 20, features=None) -> DataFrame:
    """N1 table of :func:`build_dataset` (for persistence and inverse transforms)."""
    return scaler_of(prepared_series(spark, sf_dir, lex, warmup, features), features)
