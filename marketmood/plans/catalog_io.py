"""Registered queries of the readers, writers, registry and models that have a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.functions.dates import utc_day
from marketmood.operators import ml as ML
from marketmood.operators import redact as RD
from marketmood.operators import sequences as SQ
from marketmood.plans import catalog_ml as CM
from marketmood.plans import pipeline as P
from marketmood.plans.catalog import W, r, register, rounded
from marketmood.plans.oracle_sql import LEMMA_CTE
from marketmood.session import shared_path
from marketmood.sources import fixtures as FX
from marketmood.sources import readers as RE
from marketmood.sources.registry import latest_model


# ---------------------------------------------------------------- readers and writers
@register("s1_read_posts_csv", W("posts") + """
SELECT symbol, CAST(ts AS DATE) AS day, CAST(doc_id AS VARCHAR) AS company, md5(text) AS text_md5 FROM posts
""")
def s1_read_posts_csv(spark, sf_dir):
    path = shared_path(spark, "posts-csv")
    posts = FX.posts(spark, sf_dir).select(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("date"), "text", "symbol",
        F.col("doc_id").cast("string").alias("company"))
    RE.write_posts(posts, path, fmt="csv", partition_by=None, compression="lz4")
    back = RE.read_posts(spark, path)
    return back.select("symbol", utc_day("ts").alias("day"), "company", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


PRICE_ROWS = f"""
SELECT symbol, date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close,
       {r('close')} AS adj_close, volume FROM prices
"""


def _prices_back(spark, sf_dir, fmt):
    path = shared_path(spark, f"prices-{fmt}")
    p = FX.prices(spark, sf_dir).withColumn("adj_close", F.col("close"))
    if fmt == "csv":
        p.select("date", "open", "high", "low", "close", "adj_close", "volume", "symbol").write.option("header", True).csv(path)
    else:
        p.write.format(fmt).save(path)
    back = RE.read_prices(spark, path, fmt, unique=True)
    return rounded(back.select("symbol", "date", "open", "high", "low", "close", "adj_close", "volume"))


@register("s2_read_prices_csv", W("prices") + PRICE_ROWS)
def s2_read_prices_csv(spark, sf_dir):
    return _prices_back(spark, sf_dir, "csv")


@register("s2_read_prices_parquet", W("prices") + PRICE_ROWS)
def s2_read_prices_parquet(spark, sf_dir):
    return _prices_back(spark, sf_dir, "parquet")


@register("s3_scored_posts", W("posts", "scores") + ",\n" + CM.KEPT_SQL + ",\n" + LEMMA_CTE + f""",
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM k),
g AS (SELECT e.doc_id, list(regexp_replace(coalesce(l.lemma, e.tok), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') ORDER BY e.pos) AS lem
      FROM e LEFT JOIN lemmas l ON e.tok = l.form GROUP BY e.doc_id),
cl AS (SELECT k.doc_id, array_to_string(coalesce(g.lem, []), ' ') AS cleaned FROM k LEFT JOIN g ON k.doc_id = g.doc_id)
SELECT p.symbol, CAST(p.ts AS DATE) AS day, CAST(p.doc_id AS VARCHAR) AS company, md5(cl.cleaned) AS cleaned_md5,
       CAST(length(p.text) AS BIGINT) AS text_length, {r('s.compound')} AS compound
FROM posts p JOIN scores s ON p.doc_id = s.doc_id JOIN cl ON p.doc_id = cl.doc_id
""")
def s3_scored_posts(spark, sf_dir):
    path = shared_path(spark, "scored-posts")
    RE.write_posts(P.scored_posts_table(spark, sf_dir), path, compression="zstd")
    back = RE.read_posts(spark, path, fmt="parquet", scored=True)
    return rounded(back.select("symbol", utc_day("ts").alias("day"), "company", F.md5("cleaned_text").alias("cleaned_md5"),
                               "text_length", "compound"))


# ---------------------------------------------------------------- registry, deletions
@register("s6_latest_model", """
SELECT o_orderpriority AS symbol, max(o_orderkey % 500) AS version,
       '/models/' || o_orderpriority || '/x_generator_V_' || max(o_orderkey % 500) || '.h5' AS path
FROM orders GROUP BY 1
""")
def s6_latest_model(spark, sf_dir):
    o = RE.read_table(spark, sf_dir, "orders")
    name = F.concat(F.lit("/models/"), "o_orderpriority", F.lit("/x_generator_V_"), F.col("o_orderkey") % 500, F.lit(".h5"))
    other = F.concat(F.lit("/models/"), "o_orderpriority", F.lit("/critic_V_"), F.col("o_orderkey"), F.lit(".h5"))
    listing = o.select(F.col("o_orderpriority").alias("symbol"), F.explode(F.array(name, other)).alias("path"))
    return latest_model(listing).select("symbol", "version", "path")


@register("g4_deleted_since", """
WITH f AS (SELECT regexp_extract(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://([^?#]*)', 1), '([^/]*)$', 1),
                                 '^\\.*[^.].*(\\.[^.]*)$', 1) AS extension,
                  CASE WHEN page_id % 5 > 0 OR url LIKE '%.html%' THEN DATE '2020-01-01' + CAST(page_id % 365 AS INTEGER) END AS gone
           FROM pages)
SELECT extension, CASE WHEN count(*) = count(gone) THEN max(gone) END AS deleted_since FROM f GROUP BY 1
""")
def g4_deleted_since(spark, sf_dir):
    pages = RE.read_table(spark, sf_dir, "pages")
    gone = F.when((F.col("page_id") % 5 > 0) | F.col("url").contains(".html"),
                  F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    names = pages.select(F.regexp_extract("url", "^[a-zA-Z]+://([^?#]*)", 1).alias("name"), gone.alias("deleted_at"))
    return RD.deleted_since(names)


# ---------------------------------------------------------------- models with a closed form
LINE_SQL = """,
sq AS (SELECT symbol, date, close / 1e5 AS x, lead(close) OVER w / 1e5 AS y, lead(date) OVER w AS target_date,
              row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back
       FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sp AS (SELECT *, CASE WHEN back <= 21 THEN 'test' ELSE 'train' END AS split FROM sq WHERE y IS NOT NULL),
fit AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n_train FROM sp WHERE split = 'train' GROUP BY 1)
"""


def _line(spark, sf_dir):
    """One-step sequences of the scaled close, and the unpenalised line of each symbol."""
    p = FX.prices(spark, sf_dir).select("symbol", "date", (F.col("close") / 1e5).alias("close"))
    seq = SQ.split_last(SQ.make_sequences(p, ["close"], "close", 1, 1), 20)
    return seq, ML.fit_forecaster(seq, ridge=0.0)


@register("m5_line_fit", W("prices") + LINE_SQL + f"""
SELECT symbol, n_train, {r('a')} AS intercept, {r('b')} AS slope FROM fit
""")
def m5_line_fit(spark, sf_dir):
    _, coefs = _line(spark, sf_dir)
    return rounded(coefs.select("symbol", "n_train", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")))


@register("m6_line_forecast", W("prices") + LINE_SQL + f"""
SELECT sp.symbol, target_date, split, {r('a + b * x')} AS pred FROM sp JOIN fit ON sp.symbol = fit.symbol
""")
def m6_line_forecast(spark, sf_dir):
    seq, coefs = _line(spark, sf_dir)
    return rounded(ML.forecast(seq, coefs).select("symbol", "target_date", "split", F.col("pred")[0].alias("pred")))


@register("s5_model_round_trip", """
SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_test, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_equal FROM documents
""")
def s5_model_round_trip(spark, sf_dir):
    """Predictions of the saved and loaded classifier against those of the fitted one."""
    labelled, model = CM._classifier(spark, sf_dir)
    path = shared_path(spark, "classifier")
    ML.save_model(model, path)
    test = CM._with_text(spark, sf_dir, labelled.filter(F.col("split") == "test"))
    a = ML.predict_sentiment(test, model).select("doc_id", F.col("p_positive").alias("a"))
    b = ML.predict_sentiment(test, ML.load_model(path)).select("doc_id", F.col("p_positive").alias("b"))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


# Compatibility decomposition leaves ASCII texts as they are.
@register("t7_nfkd_ascii", """
SELECT doc_id, md5(text) AS nfkd_md5 FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')
""")
def t7_nfkd_ascii(spark, sf_dir):
    d = RE.read_text_table(spark, sf_dir, "documents", "doc_id").filter(F.col("text").rlike("^[\\x00-\\x7F]*$"))
    return d.select("doc_id", F.md5(TX.nfkd("text")).alias("nfkd_md5"))
