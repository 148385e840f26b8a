"""Registered queries, phase 3: token tables, prediction tables, MLlib models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.functions.numeric import round_half_up
from marketmood.operators import evaluation as EV
from marketmood.operators import joins as J
from marketmood.operators import ml as ML
from marketmood.operators import scaling as SC
from marketmood.operators import sequences as SQ
from marketmood.operators import text_ops as TO
from marketmood.plans import catalog_series as CS
from marketmood.plans import pipeline as P
from marketmood.plans.catalog import W, r, register, rounded
from marketmood.plans.oracle_sql import LEMMA_CTE, STOP_LIST
from marketmood.session import store
from marketmood.sources import fixtures as FX
from marketmood.sources.readers import read_text_table

TOKEN_RE = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
KEPT_SQL = f"""k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(text, 'http\\S+', '', 'g')),
                   '{TOKEN_RE}'), lambda t: NOT list_contains({STOP_LIST}, t)) AS toks FROM documents)"""
VOCAB_SQL = """c AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM k) GROUP BY token),
v AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS id
      FROM (SELECT * FROM c ORDER BY n DESC, token LIMIT 1000))"""


def _kept(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", TX.drop_stopwords(TX.word_tokens(TX.strip_urls("text"))).alias("tokens"))


def _words(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", TX.word_tokens("text").alias("tokens"))


@register("t14_build_vocab", "WITH " + KEPT_SQL + ",\n" + VOCAB_SQL + "\nSELECT token, n, id FROM v")
def t14_build_vocab(spark, sf_dir):
    return TO.build_vocab(_kept(spark, sf_dir), "tokens", 1000)


@register("t13_encode_tokens", "WITH " + KEPT_SQL + ",\n" + VOCAB_SQL + """,
e AS (SELECT doc_id, unnest(toks[1:158]) AS tok, unnest(range(1, len(toks[1:158]) + 1)) AS pos FROM k),
g AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN v ON e.tok = v.token GROUP BY e.doc_id),
f AS (SELECT k.doc_id, list_concat([CAST(2 AS BIGINT)], coalesce(g.ids, []), [CAST(3 AS BIGINT)]) AS ids
      FROM k LEFT JOIN g ON k.doc_id = g.doc_id)
SELECT doc_id, list_concat(ids, list_transform(range(160 - len(ids)), lambda x: CAST(0 AS BIGINT))) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda x: CAST(1 AS BIGINT)),
                   list_transform(range(160 - len(ids)), lambda x: CAST(0 AS BIGINT))) AS attention_mask
FROM f
""")
def t13_encode_tokens(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    vocab = TO.build_vocab(kept, "tokens", 1000)
    return TO.encode_tokens(kept, vocab, "doc_id", "tokens", 160)


@register("t3_lemmatise", "WITH " + LEMMA_CTE + """,
k AS (SELECT doc_id, regexp_extract_all(lower(text), '""" + TOKEN_RE + """') AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM k),
g AS (SELECT e.doc_id, list(coalesce(l.lemma, e.tok) ORDER BY e.pos) AS lem
      FROM e LEFT JOIN lemmas l ON e.tok = l.form GROUP BY e.doc_id)
SELECT k.doc_id, array_to_string(coalesce(g.lem, []), ' ') AS lemmas FROM k LEFT JOIN g ON k.doc_id = g.doc_id
""")
def t3_lemmatise(spark, sf_dir):
    lem = TO.lemmatise(_words(spark, sf_dir), FX.lemmas(spark), "doc_id", "tokens", "l")
    return lem.select("doc_id", F.array_join("l", " ").alias("lemmas"))


@register("j6_stopword_anti_join", f"""
WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}') AS toks FROM documents)
SELECT doc_id, count(*) AS n_kept
FROM (SELECT doc_id, unnest(toks) AS tok FROM k) WHERE NOT list_contains({STOP_LIST}, tok) GROUP BY doc_id
""")
def j6_stopword_anti_join(spark, sf_dir):
    kept = TO.drop_stopwords_join(_words(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@register("j4_prediction_table", W("prices") + CS.PSEQ_SQL + CS._pseq_split(1) + f"""
SELECT ps.symbol, ps.d1 AS date, {r('p.close')} AS real, {r('ps.last_close')} AS predicted
FROM ps JOIN prices p ON ps.symbol = p.symbol AND ps.d1 = p.date
WHERE ps.split = 'test' AND ps.d1 BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'
""")
def j4_prediction_table(spark, sf_dir):
    pers = CS._persistence(spark, sf_dir, 1).filter(F.col("split") == "test")
    pred = pers.select("symbol", F.col("target_date").alias("date"), F.col("pred")[0].alias("predicted"))
    out = J.prediction_table(pred, FX.prices(spark, sf_dir), dt.date(2001, 1, 1), dt.date(2001, 12, 31))
    return rounded(out)


@register("k3_head_per_symbol", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM prices) WHERE rn <= 10
""")
def k3_head_per_symbol(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    return rounded(J.head_per_symbol(p, 10))


# ---------------------------------------------------------------- classifier (rows-only checks)
def _labelled_docs(spark, sf_dir):
    """Ids, labels and split sides; text is joined where a model reads it."""
    scores = P.document_scores(spark, sf_dir).select("doc_id", TX.threshold_label("compound").alias("label"))
    return store(SQ.hash_split(store(scores, "labelled-docs"), "doc_id", 0.2, 42), "split-docs")


def _with_text(spark, sf_dir, labelled):
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return docs.join(labelled, "doc_id")


# Fitted models are reused by the queries of one application as long as the files
# they were fitted on stay as they are (the classifier feeds m3/m4/m8, the
# forecaster m5/m6): fit once, not per query.
_FITTED: dict = {}


def _files(spark, sf_dir, *tables):
    """Path, time and size of every file of the tables; their contents aren't read."""
    paths = [p for t in tables for p in spark.read.parquet(f"{sf_dir}/{t}.parquet").inputFiles()]
    rows = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length").collect()
    return tuple(sorted((r["path"], str(r["modificationTime"]), r["length"]) for r in rows))


def _fitted(spark, sf_dir, name, fit):
    app = spark.sparkContext.applicationId
    for key in [k for k in _FITTED if k[0] != app]:  # of an application that has ended
        del _FITTED[key]
    key = (app, name, _files(spark, sf_dir, "documents", "orders"))
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _classifier(spark, sf_dir):
    def fit():
        labelled = _labelled_docs(spark, sf_dir)
        train = _with_text(spark, sf_dir, labelled.filter(F.col("split") == "train"))
        return labelled, ML.fit_sentiment_classifier(train, "text", "label", max_iter=30)
    return _fitted(spark, sf_dir, "classifier", fit)


def _predicted(spark, sf_dir):
    labelled, model = _classifier(spark, sf_dir)
    test = _with_text(spark, sf_dir, labelled.filter(F.col("split") == "test"))
    return ML.predict_sentiment(test, model, keep=("doc_id", "label"))


@register("m3_predict_sentiment")
def m3_predict_sentiment(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir))


@register("m4_classifier_report")
def m4_classifier_report(spark, sf_dir):
    return rounded(EV.classification_report(_predicted(spark, sf_dir), "label", "prediction"))


@register("m8_training_history")
def m8_training_history(spark, sf_dir):
    _, model = _classifier(spark, sf_dir)
    return ML.training_history(model)


# ---------------------------------------------------------------- forecaster (rows-only checks)
def _forecasts(spark, sf_dir):
    def fit():
        # The prepared series feeds the data set and the scaler, the data set the
        # fit, the forecasts and two evaluations: each is written once.
        series = store(P.prepared_series(spark, sf_dir), "series")
        seq = store(P.dataset_of(series), "dataset")
        coefs = store(ML.fit_forecaster(seq), "coefs")
        return seq, coefs, ML.forecast(seq, coefs), store(P.scaler_of(series), "scaler")
    return _fitted(spark, sf_dir, "forecaster", fit)


def _to_price(df, scaler, col):
    f = scaler.filter(F.col("feature") == "target")
    d = df.withColumn("_s", F.col(col)[0])
    d = SC.invert_minmax(d, f, "_s", "target")
    return d.withColumn(col, F.array("_s")).drop("_s")


@register("m5_fit_forecaster")
def m5_fit_forecaster(spark, sf_dir):
    _, coefs, _, _ = _forecasts(spark, sf_dir)
    return coefs.select("symbol", F.size("coef").cast("bigint").alias("n_coef"), "n_train",
                        round_half_up(F.col("coef")[0]).alias("intercept"))


@register("m6_forecast")
def m6_forecast(spark, sf_dir):
    _, _, pred, scaler = _forecasts(spark, sf_dir)
    priced = _to_price(_to_price(pred, scaler, "pred"), scaler, "y")
    model = EV.evaluate_forecast(priced).withColumnRenamed("rmse", "rmse_model").drop("n")
    base = EV.evaluate_forecast(_to_price(_to_price(EV.persistence_forecast(pred), scaler, "pred"), scaler, "y"))
    return rounded(model.join(base.withColumnRenamed("rmse", "rmse_persistence"), ["symbol", "split"]))
