"""Registered queries of training in rounds (S5, M2-M5, M8): every number is held to the same rounds in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.operators import evaluation as EV
from marketmood.operators import ml as ML
from marketmood.operators import training as TR
from marketmood.plans import catalog_io as CI
from marketmood.plans.catalog import W, r, register, rounded
from marketmood.plans.catalog_series import REPORT_SQL
from marketmood.plans.oracle_sql import q
from marketmood.session import shared_path, store
from marketmood.sources.fixtures import DEMO_LEXICON
from marketmood.sources.readers import read_table, read_text_table

# --- fixed values -----------------------------------------------------------
# Vocabulary, rounds and steps of the registered training runs.
VOCABULARY = [w for w, _ in DEMO_LEXICON] + ["the", "and", "der", "de"]
ROUNDS, RATE, MOMENTUM = 4, 0.5, 0.9
LINE_ROUNDS, LINE_RATE = 3, 0.02
# --- end of fixed values ----------------------------------------------------


def _data(spark, sf_dir):
    """Labelled documents with features: class 0 toxic, 1 of low quality, 2 others; every fifth id validates."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
                                                     .otherwise(2).alias("label"))
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").join(lab, "doc_id")
    return store(docs.select("doc_id", "label", (F.col("doc_id") % 5 != 0).alias("train"),
                             TR.word_features(TX.word_tokens("text"), VOCABULARY).alias("features")), "features")


def _train(data, rounds=ROUNDS, **state):
    return TR.train_classifier(data, len(VOCABULARY) + 1, rounds=rounds, rate=RATE, momentum=MOMENTUM, **state)


def _rounds_sql(rounds: int = ROUNDS) -> str:
    """CTEs x(doc_id, j, v), y(doc_id, label, train), and for round n: p<n>, loss<n>, w<n + 1>(j, k, w, s)."""
    words = ", ".join(f"({q(w)}, {i + 1})" for i, w in enumerate(VOCABULARY))
    parts = [f"""WITH vocab(token, j) AS (VALUES {words}),
y AS (SELECT d.doc_id, d.text, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label, d.doc_id % 5 <> 0 AS train
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT doc_id, j, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),
        '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS token FROM y) t JOIN vocab USING (token) GROUP BY 1, 2),
x AS (SELECT doc_id, 0 AS j, CAST(1 AS DOUBLE) AS v FROM y UNION ALL SELECT doc_id, j, ln(1 + CAST(n AS DOUBLE)) FROM n),
w0 AS (SELECT j, k, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS s FROM range({len(VOCABULARY) + 1}) a(j), range(3) b(k))"""]
    for i in range(rounds):
        parts.append(f"""z{i} AS (SELECT doc_id, k, exp(sum(v * w)) AS e FROM x JOIN w{i} USING (j) GROUP BY 1, 2),
p{i} AS (SELECT z.doc_id, k, label, train, e / sum(e) OVER (PARTITION BY z.doc_id) AS p FROM z{i} z JOIN y ON z.doc_id = y.doc_id),
loss{i} AS (SELECT avg(-ln(p)) FILTER (WHERE train) AS t, avg(-ln(p)) FILTER (WHERE NOT train) AS u FROM p{i} WHERE k = label),
g{i} AS (SELECT x.j, p.k, sum((p.p - CASE WHEN k = label THEN 1 ELSE 0 END) * v) / (SELECT count(*) FROM y WHERE train) AS g
         FROM p{i} p JOIN x ON x.doc_id = p.doc_id WHERE train GROUP BY 1, 2),
w{i + 1} AS (SELECT j, k, w - {RATE} * ({MOMENTUM} * s + coalesce(g, 0)) AS w, {MOMENTUM} * s + coalesce(g, 0) AS s
             FROM w{i} LEFT JOIN g{i} USING (j, k))""")
    parts.append(f"""zz AS (SELECT doc_id, k, exp(sum(v * w)) AS e FROM x JOIN w{rounds} USING (j) GROUP BY 1, 2),
pp AS (SELECT doc_id, max(CASE WHEN k = 0 THEN e END) / sum(e) AS p0, max(CASE WHEN k = 1 THEN e END) / sum(e) AS p1,
              max(CASE WHEN k = 2 THEN e END) / sum(e) AS p2 FROM zz GROUP BY 1),
pred AS (SELECT pp.*, label, train, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS c
         FROM pp JOIN y ON pp.doc_id = y.doc_id)""")
    return ",\n".join(parts)


HISTORY_SQL = _rounds_sql() + "\n" + "\nUNION ALL ".join(
    f"SELECT 'sentiment' AS model, {i} AS round, {r('t')} AS train_loss, {r('u')} AS valid_loss FROM loss{i}" for i in range(ROUNDS))


@register("m2_round_weights", _rounds_sql() + f"\nSELECT CAST(j AS INTEGER) AS at, CAST(k AS INTEGER) AS class, {r('w')} AS weight FROM w{ROUNDS}")
def m2_round_weights(spark, sf_dir):
    model = _train(_data(spark, sf_dir))
    rows = [(i, k, float(w)) for i, row in enumerate(model.weights) for k, w in enumerate(row)]
    return rounded(spark.createDataFrame(rows, "at int, class int, weight double"))


@register("m3_round_predictions", _rounds_sql() + f"""
SELECT doc_id, CAST(c AS BIGINT) AS prediction, ['Negative', 'Neutral', 'Positive'][c + 1] AS label_name, {r('p0')} AS p_negative,
       {r('p1')} AS p_neutral, {r('p2')} AS p_positive FROM pred WHERE NOT train""")
def m3_round_predictions(spark, sf_dir):
    data = _data(spark, sf_dir)
    return rounded(TR.predict_classes(data.filter(~F.col("train")), _train(data)))


@register("m4_round_report", _rounds_sql() + ",\nlab AS (SELECT label AS t, c AS p FROM pred WHERE NOT train),\n" + REPORT_SQL)
def m4_round_report(spark, sf_dir):
    data = _data(spark, sf_dir)
    found = TR.predict_classes(data.filter(~F.col("train")), _train(data), keep=("doc_id", "label"))
    return rounded(EV.classification_report(found, "label", "prediction"))


@register("m8_round_history", HISTORY_SQL)
def m8_round_history(spark, sf_dir):
    return rounded(TR.history(spark, _train(_data(spark, sf_dir))))


@register("s5_resumed_training", HISTORY_SQL)
def s5_resumed_training(spark, sf_dir):
    """Training that stops after two rounds, goes on from its saved state, and is loaded once more."""
    data, folder = _data(spark, sf_dir), shared_path(spark, "classifier-state")
    _train(data, 2, folder=folder, save_every=1)
    _train(data, folder=folder, save_every=1)
    return rounded(TR.history(spark, TR.load_state(spark, folder)))


def _line_rounds_sql() -> str:
    parts = ["""sums AS (SELECT symbol, split, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy
         FROM sp GROUP BY 1, 2),
c0 AS (SELECT symbol, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS va, CAST(0 AS DOUBLE) AS vb
       FROM sums WHERE split = 'train')"""]
    for i in range(LINE_ROUNDS):
        parts.append(f"""l{i} AS (SELECT symbol, max(CASE WHEN split = 'train' THEN l END) AS t, max(CASE WHEN split = 'test' THEN l END) AS u FROM (
         SELECT c.symbol, split, (n * a * a + 2 * a * b * sx + b * b * sxx - 2 * a * sy - 2 * b * sxy + syy) / n AS l
         FROM c{i} c JOIN sums s ON s.symbol = c.symbol) GROUP BY 1),
c{i + 1} AS (SELECT symbol, a - {LINE_RATE} * va AS a, b - {LINE_RATE} * vb AS b, va, vb FROM (
         SELECT c.symbol, a, b, 0.9 * va + 2 * (n * a + sx * b - sy) / n AS va, 0.9 * vb + 2 * (sx * a + sxx * b - sxy) / n AS vb
         FROM c{i} c JOIN sums s ON s.symbol = c.symbol AND split = 'train'))""")
    return ",\n" + ",\n".join(parts) + "\n"


def _line_rounds(spark, sf_dir, **state):
    seq, _ = CI._line(spark, sf_dir)
    return TR.train_forecaster(seq, rounds=LINE_ROUNDS, rate=LINE_RATE, **state)


@register("m8_forecaster_history", W("prices") + CI.LINE_SQL + _line_rounds_sql() + "\nUNION ALL ".join(
    f"SELECT symbol, {i} AS round, {r('t')} AS train_loss, {r('u')} AS valid_loss FROM l{i}" for i in range(LINE_ROUNDS)))
def m8_forecaster_history(spark, sf_dir):
    return rounded(_line_rounds(spark, sf_dir)[1])


@register("s5_saved_coefficients", W("prices") + CI.LINE_SQL + _line_rounds_sql() + f"""
SELECT sp.symbol, target_date, split, {r('a + b * x')} AS pred FROM sp JOIN c{LINE_ROUNDS} c ON sp.symbol = c.symbol
""")
def s5_saved_coefficients(spark, sf_dir):
    """Coefficients of resumed rounds, saved, loaded and applied."""
    state = shared_path(spark, "forecaster-state")
    seq, _ = CI._line(spark, sf_dir)
    TR.train_forecaster(seq, rounds=1, rate=LINE_RATE, folder=state, save_every=1)
    coefs, _ = _line_rounds(spark, sf_dir, folder=state, save_every=1)
    path = shared_path(spark, "coefficients")
    TR.save_coefs(coefs, path)
    found = ML.forecast(seq, TR.load_coefs(spark, path))
    return rounded(found.select("symbol", "target_date", "split", F.col("pred")[0].alias("pred")))
