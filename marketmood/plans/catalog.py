"""Registered queries: one Spark plan and (where expressible) one DuckDB oracle per operator.

Every query reads the driver's tables (or views Spark derives from them) in
full. Doubles are reported rounded to 6 decimals with the same half-up
formula on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.functions import dates as D
from marketmood.functions import text as TX
from marketmood.functions.numeric import round_half_up
from marketmood.operators import filters as FL
from marketmood.operators import indicators as ind
from marketmood.operators import joins as J
from marketmood.operators import rollups as R
from marketmood.plans import oracle_sql as O
from marketmood.plans import pipeline as P
from marketmood.sources import fixtures as FX
from marketmood.sources.readers import read_table, read_text_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (report formatting shared with the oracle)."""
    return df.select(*[round_half_up(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


r = O.r
W = O.with_views


# ---------------------------------------------------------------- flagship
@register("flagship_daily_features", W("daily") + f"""
SELECT symbol, date, {r('compound')} AS compound, {r('close')} AS close,
  {r('CASE WHEN count(close) OVER w7 = 7 THEN avg(close) OVER w7 END')} AS ma7,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END')} AS ma20,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 + 2.0 * stddev_samp(close) OVER w20 END')} AS upper_band,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 - 2.0 * stddev_samp(close) OVER w20 END')} AS lower_band,
  {r('CASE WHEN close / lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END')} AS log_return
FROM daily
WINDOW w AS (PARTITION BY symbol ORDER BY date),
       w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def flagship_daily_features(spark, sf_dir):
    return rounded(P.daily_features(spark, sf_dir))


# ---------------------------------------------------------------- sources
@register("s2_daily_prices", W("prices") + f"""
SELECT symbol, date, {r('open')} AS open, {r('close')} AS close, {r('high')} AS high,
       {r('low')} AS low, volume FROM prices
""")
def s2_daily_prices(spark, sf_dir):
    return rounded(FX.prices(spark, sf_dir))


@register("s1_posts", W("posts") + """
SELECT post_id, ts, symbol, doc_id, CAST(length(text) AS BIGINT) AS text_length FROM posts
""")
def s1_posts(spark, sf_dir):
    p = FX.posts(spark, sf_dir)
    return p.select("post_id", "ts", "symbol", "doc_id", TX.text_length("text").alias("text_length"))


@register("s7_profile_shape", W("prices") + """
SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns FROM prices
""")
def s7_profile_shape(spark, sf_dir):
    from marketmood.sources.readers import profile_shape
    return profile_shape(FX.prices(spark, sf_dir))


# ---------------------------------------------------------------- sentiment
@register("t6_sentiment_scores", W("scores") + """
SELECT doc_id, neg, neu, pos, compound FROM scores
""")
def t6_sentiment_scores(spark, sf_dir):
    return P.document_scores(spark, sf_dir)


@register("t8_bad_rows", """
SELECT count(*) AS n_bad FROM documents WHERE text IS NULL
""")
def t8_bad_rows(spark, sf_dir):
    from marketmood.operators.sentiment import bad_rows
    return bad_rows(read_table(spark, sf_dir, "documents")).agg(F.count(F.lit(1)).alias("n_bad"))


# ---------------------------------------------------------------- rollups
@register("a1_daily_mean", W("scored_posts") + f"""
SELECT symbol, CAST(ts AS DATE) AS date, {r('avg(compound)')} AS compound, {r('avg(neg)')} AS neg,
       {r('avg(neu)')} AS neu, {r('avg(pos)')} AS pos
FROM scored_posts GROUP BY 1, 2
""")
def a1_daily_mean(spark, sf_dir):
    p = FX.posts(spark, sf_dir, with_text=False)
    s = P.document_scores(spark, sf_dir)
    sp = p.join(s, "doc_id")
    return rounded(R.daily_mean(sp, "ts", "symbol", cols=["compound", "neg", "neu", "pos"]))


@register("a2_sentiment_by_day", W("scored_posts") + f"""
SELECT CAST(ts AS DATE) AS date, {r('avg(compound)')} AS avg_compound FROM scored_posts GROUP BY 1
""")
def a2_sentiment_by_day(spark, sf_dir):
    return rounded(R.sentiment_by_day(P.scored_posts(spark, sf_dir)))


@register("a3_sentiment_by_symbol", W("scored_posts") + f"""
SELECT symbol, {r('avg(compound)')} AS avg_compound FROM scored_posts GROUP BY 1
""")
def a3_sentiment_by_symbol(spark, sf_dir):
    return rounded(R.sentiment_by_symbol(P.scored_posts(spark, sf_dir)))


@register("a4_posts_per_day", W("posts") + """
SELECT CAST(ts AS DATE) AS date, count(*) AS n_posts FROM posts GROUP BY 1
""")
def a4_posts_per_day(spark, sf_dir):
    return R.posts_per_day(FX.posts(spark, sf_dir, with_text=False))


@register("a5_volume_by_day", W("prices") + """
SELECT date, CAST(sum(volume) AS BIGINT) AS total_volume FROM prices GROUP BY 1
""")
def a5_volume_by_day(spark, sf_dir):
    return R.volume_by_day(FX.prices(spark, sf_dir))


@register("a6_null_counts", """
SELECT 'text' AS "column", count(*) FILTER (WHERE text IS NULL) AS nulls FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM documents
UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL) FROM documents
""")
def a6_null_counts(spark, sf_dir):
    return R.null_counts(read_table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


def _describe_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean,
  {r(f'stddev_samp({c})')} AS std, {r(f'CAST(min({c}) AS DOUBLE)')} AS min,
  {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
  {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM {src}""")
    return "\nUNION ALL\n".join(parts)


@register("a8_describe_prices", W("prices") + _describe_sql(["open", "close", "high", "low", "volume"], "prices"))
def a8_describe_prices(spark, sf_dir):
    return rounded(R.describe_numeric(FX.prices(spark, sf_dir), ["open", "close", "high", "low", "volume"]))


def _hist_sql(src, col, bins, by=None):
    byc = f"{by}, " if by else ""
    return f"""b AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {src}),
h AS (SELECT {byc}CAST(CASE WHEN b.hi = b.lo THEN 0
                      ELSE least(floor(({col} - b.lo) / ((b.hi - b.lo) / {float(bins)!r})), {bins - 1}) END AS BIGINT) AS bin,
             b.lo, b.hi
      FROM {src}, b WHERE {col} IS NOT NULL AND NOT isnan({col}))
SELECT {byc}bin, {r(f'lo + bin * ((hi - lo) / {float(bins)!r})')} AS lo,
       {r(f'lo + (bin + 1) * ((hi - lo) / {float(bins)!r})')} AS hi, count(*) AS n
FROM h GROUP BY {byc}bin, lo, hi"""


@register("a9_histogram_text_length", "WITH docs AS (SELECT CAST(length(text) AS DOUBLE) AS text_length FROM documents),\n"
          + _hist_sql("docs", "text_length", 50))
def a9_histogram_text_length(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id").select(TX.text_length("text").cast("double").alias("text_length"))
    return rounded(R.histogram(d, "text_length", 50))


@register("a9_histogram_compound", W("scores") + ",\n" + _hist_sql("scores", "compound", 50)[0:])
def a9_histogram_compound(spark, sf_dir):
    return rounded(R.histogram(P.document_scores(spark, sf_dir), "compound", 50))


@register("a10_histogram_by_category", W("scores") + """,
cat AS (SELECT compound, CASE WHEN compound IS NULL OR isnan(compound) THEN 'Neutral'
                              WHEN compound < 0 THEN 'Negative' WHEN compound > 0 THEN 'Positive'
                              ELSE 'Neutral' END AS category FROM scores),
""" + _hist_sql("cat", "compound", 20, by="category"))
def a10_histogram_by_category(spark, sf_dir):
    s = P.document_scores(spark, sf_dir).withColumn("category", TX.sign_category("compound"))
    return rounded(R.histogram(s, "compound", 20, by="category"))


@register("a11_symbol_list", W("prices") + """
SELECT symbol, min(date) AS first_seen FROM prices GROUP BY 1 ORDER BY first_seen, symbol LIMIT 6
""")
def a11_symbol_list(spark, sf_dir):
    return R.symbol_list(FX.prices(spark, sf_dir), limit=6)


@register("a13_date_bounds", W("daily") + """
SELECT symbol, min(date) AS min_date, max(date) AS max_date FROM daily GROUP BY 1
""")
def a13_date_bounds(spark, sf_dir):
    return R.date_bounds(P.daily_keys(spark, sf_dir))


@register("a17_series_length", W("daily") + """
SELECT symbol, count(*) AS n_rows FROM daily GROUP BY 1 HAVING count(*) >= 46
""")
def a17_series_length(spark, sf_dir):
    return R.series_length(P.daily_keys(spark, sf_dir), min_rows=46)


# ---------------------------------------------------------------- filters / projections
@register("f1_for_symbols", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close FROM prices WHERE symbol IN ('1-URGENT', '5-LOW')
""")
def f1_for_symbols(spark, sf_dir):
    return rounded(FL.for_symbols(FX.prices(spark, sf_dir), ["1-URGENT", "5-LOW"]).select("symbol", "date", "close"))


@register("f2_date_range", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close FROM prices
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'
""")
def f2_date_range(spark, sf_dir):
    import datetime as dt
    first, last = dt.date(1996, 1, 1), dt.date(1997, 6, 30)
    p = FX.prices(spark, sf_dir, first, last).select("symbol", "date", "close")
    return rounded(FL.date_range(p, first, last))


@register("f3_drop_strict", W("prices") + f"""
SELECT symbol, date, {r('open')} AS open, {r('close')} AS close, volume FROM prices
""")
def f3_drop_strict(spark, sf_dir):
    return rounded(FL.drop_strict(FX.prices(spark, sf_dir), ["high", "low"]))


@register("f4_numeric_columns", W("prices") + f"""
SELECT {r('open')} AS open, {r('close')} AS close, {r('high')} AS high, {r('low')} AS low, volume FROM prices
""")
def f4_numeric_columns(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    return rounded(p.select(*R.numeric_columns(p)))


@register("f8_scatter", W("posts", "scores") + f""",
post_scores AS (SELECT p.post_id, CAST(length(p.text) AS BIGINT) AS text_length, s.compound
                FROM posts p JOIN scores s ON p.doc_id = s.doc_id)
SELECT text_length, {r('compound')} AS compound FROM post_scores
""")
def f8_scatter(spark, sf_dir):
    lengths = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", TX.text_length("text").alias("text_length"))
    s = lengths.join(P.document_scores(spark, sf_dir).select("doc_id", "compound"), "doc_id")
    p = FX.posts(spark, sf_dir, with_text=False).select("doc_id").join(s, "doc_id")
    return rounded(FL.scatter(p, "text_length", "compound"))


@register("f9_price_series", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close FROM prices
""")
def f9_price_series(spark, sf_dir):
    return rounded(FL.price_series(FX.prices(spark, sf_dir), "close"))


@register("f10_volume_series", W("prices") + """
SELECT symbol, date, volume FROM prices
""")
def f10_volume_series(spark, sf_dir):
    return FL.price_series(FX.prices(spark, sf_dir), "volume")


# ---------------------------------------------------------------- joins
@register("j1_join_daily", W("daily") + f"""
SELECT symbol, date, {r('compound')} AS compound, {r('open')} AS open, {r('close')} AS close,
       {r('high')} AS high, {r('low')} AS low, volume FROM daily
""")
def j1_join_daily(spark, sf_dir):
    sent = P.daily_sentiment(P.scored_posts(spark, sf_dir))
    return rounded(J.join_daily(sent, FX.prices(spark, sf_dir)))


# ---------------------------------------------------------------- text
@register("t1_strip_urls", """
SELECT doc_id, regexp_replace(text, 'http\\S+', '', 'g') AS stripped FROM documents
""")
def t1_strip_urls(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", TX.strip_urls("text").alias("stripped"))


@register("t2_word_tokens", """
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM documents)
""")
def t2_word_tokens(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", TX.word_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("t4_drop_stopwords", f"""
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_kept, array_to_string(k, ' ') AS kept
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(text, 'http\\S+', '', 'g')),
                                 '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'),
                                 lambda t: NOT list_contains({O.STOP_LIST}, t)) AS k FROM documents)
""")
def t4_drop_stopwords(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    k = TX.drop_stopwords(TX.word_tokens(TX.strip_urls("text")))
    return d.select("doc_id", k.alias("k")).select(
        "doc_id", F.size("k").cast("bigint").alias("n_kept"), F.array_join("k", " ").alias("kept"))


@register("t5_clean_text", f"""
SELECT doc_id, array_to_string(list_transform(
         list_filter(regexp_extract_all(lower(regexp_replace(text, 'http\\S+', '', 'g')),
                                        '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'),
                     lambda t: NOT list_contains({O.STOP_LIST}, t)),
         lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), ' ') AS cleaned_text
FROM documents
""")
def t5_clean_text(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", TX.clean_text("text").alias("cleaned_text"))


@register("t9_text_length", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents
""")
def t9_text_length(spark, sf_dir):
    return read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", TX.text_length("text").alias("text_length"))


@register("t10_sign_category", W("scores") + """
SELECT doc_id, CASE WHEN compound IS NULL OR isnan(compound) THEN 'Neutral' WHEN compound < 0 THEN 'Negative'
                    WHEN compound > 0 THEN 'Positive' ELSE 'Neutral' END AS category
FROM scores
""")
def t10_sign_category(spark, sf_dir):
    return P.document_scores(spark, sf_dir).select("doc_id", TX.sign_category("compound").alias("category"))


@register("t11_threshold_label", W("scores") + """
SELECT doc_id, CAST(CASE WHEN compound IS NULL THEN NULL WHEN compound <= 0.4 THEN 0
                         WHEN compound <= 0.6 THEN 1 ELSE 2 END AS BIGINT) AS label
FROM scores
""")
def t11_threshold_label(spark, sf_dir):
    return P.document_scores(spark, sf_dir).select("doc_id", TX.threshold_label("compound").alias("label"))


@register("t12_decode_label", W("scores") + """
SELECT doc_id, CASE CASE WHEN compound <= 0.4 THEN 0 WHEN compound <= 0.6 THEN 1 ELSE 2 END
                 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS label_name
FROM scores
""")
def t12_decode_label(spark, sf_dir):
    s = P.document_scores(spark, sf_dir)
    return s.select("doc_id", TX.decode_label(TX.threshold_label("compound")).alias("label_name"))


@register("t7_nfkd")
def t7_nfkd(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", TX.text_length(TX.nfkd("text")).alias("nfkd_length"))


# ---------------------------------------------------------------- dates
@register("d1_parse_utc", """
SELECT post_id, CAST(CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE) AS day
FROM (SELECT o_orderkey AS post_id, o_orderdate FROM orders)
""")
def d1_parse_utc(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    s = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return o.select(F.col("o_orderkey").alias("post_id"),
                    D.utc_day(D.parse_utc(s)).alias("day"))


@register("d4_format_day", W("prices") + """
SELECT symbol, strftime(date, '%Y-%m-%d') AS day FROM prices
""")
def d4_format_day(spark, sf_dir):
    return FX.prices(spark, sf_dir).select("symbol", D.format_day("date").alias("day"))


# ---------------------------------------------------------------- windows
@register("w1_moving_average", W("prices") + f"""
SELECT symbol, date,
  {r('CASE WHEN count(close) OVER w7 = 7 THEN avg(close) OVER w7 END')} AS ma7,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END')} AS ma20
FROM prices
WINDOW w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def w1_moving_average(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", ind.moving_average("close", 7).alias("ma7"),
                            ind.moving_average("close", 20).alias("ma20")))


@register("w2_moving_std", W("prices") + f"""
SELECT symbol, date,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END')} AS sd20
FROM prices
WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def w2_moving_std(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", ind.moving_std("close", 20).alias("sd20")))


@register("w3_bollinger", W("prices") + f"""
SELECT symbol, date,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 + 2.0 * stddev_samp(close) OVER w20 END')} AS upper_band,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 - 2.0 * stddev_samp(close) OVER w20 END')} AS lower_band
FROM prices
WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def w3_bollinger(spark, sf_dir):
    p = ind.bollinger(FX.prices(spark, sf_dir), "close", 20, 2.0)
    return rounded(p.select("symbol", "date", "upper_band", "lower_band"))


@register("w7_log_return", W("prices") + f"""
SELECT symbol, date,
  {r('CASE WHEN close / lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END')} AS log_return
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)
""")
def w7_log_return(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", ind.log_return("close").alias("log_return")))


@register("w8_log_level", W("prices") + f"""
SELECT symbol, date, {r('CASE WHEN close - 1.0 > 0 THEN ln(close - 1.0) END')} AS logmomentum FROM prices
""")
def w8_log_level(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", ind.log_level("close", -1.0).alias("logmomentum")))


@register("w13_with_position", W("prices") + """
SELECT symbol, date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS pos FROM prices
""")
def w13_with_position(spark, sf_dir):
    return ind.with_position(FX.prices(spark, sf_dir)).select("symbol", "date", "pos")


# Later phases register into the same tables.
from marketmood.plans import catalog_series as _series  # noqa: E402,F401
from marketmood.plans import catalog_ml as _ml  # noqa: E402,F401
from marketmood.plans import catalog_p4 as _p4  # noqa: E402,F401
from marketmood.plans import catalog_io as _io  # noqa: E402,F401
from marketmood.plans import catalog_training as _training  # noqa: E402,F401
from marketmood.plans import catalog_edges as _edges  # noqa: E402,F401
from marketmood.plans import catalog_words as _words  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
