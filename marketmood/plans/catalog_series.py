"""Registered queries, phase 2: EMAs, alignment, scaling, sequences, splits, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.functions.numeric import round_half_up
from marketmood.operators import carry as CA
from marketmood.operators import evaluation as EV
from marketmood.operators import filters as FL
from marketmood.operators import indicators as ind
from marketmood.operators import joins as J
from marketmood.operators import scaling as SC
from marketmood.operators import sequences as SQ
from marketmood.plans import pipeline as P
from marketmood.plans.catalog import ORACLE, W, r, register, rounded
from marketmood.plans.oracle_sql import dbl
from marketmood.sources import fixtures as FX

A12, A26, A05 = 2.0 / 13.0, 2.0 / 27.0, 1.0 / 1.5


def WR(*names):
    return W(*names).replace("WITH ", "WITH RECURSIVE ", 1)


def _ema_ctes(src: str, col: str = "close") -> str:
    """Recursive EMA oracle over ``src(symbol, date, {col})``: e12, e26 (not adjusted),
    an/ad (adjusted, com 0.5)."""
    return f""",
eb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {src}),
er(symbol, rn, e12, e26, an, ad) AS (
  SELECT symbol, rn, {col}, {col}, {col}, {dbl(1.0)} FROM eb WHERE rn = 1
  UNION ALL
  SELECT eb.symbol, eb.rn,
         {dbl(1 - A12)} * er.e12 + {dbl(A12)} * eb.{col},
         {dbl(1 - A26)} * er.e26 + {dbl(A26)} * eb.{col},
         {dbl(1 - A05)} * er.an + eb.{col},
         {dbl(1 - A05)} * er.ad + {dbl(1.0)}
  FROM er JOIN eb ON eb.symbol = er.symbol AND eb.rn = er.rn + 1)"""


# ---------------------------------------------------------------- EMAs
# The block scan adds up in another order than the recursion: 3 decimals of values up to 1e6 are compared.
@register("w4_ema_recursive", WR("prices") + _ema_ctes("prices") + f"""
SELECT eb.symbol, eb.date, {r('er.e12', 3)} AS ema12, {r('er.e26', 3)} AS ema26
FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
""")
def w4_ema_recursive(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    p = ind.ema_block_scan(p, "close", [2.0 / 13.0, 2.0 / 27.0], ["ema12", "ema26"])
    return rounded(p.select("symbol", "date", "ema12", "ema26"), 3)


@register("w4_ema_frame", WR("prices") + _ema_ctes("prices") + f"""
SELECT eb.symbol, eb.date, {r('er.e12')} AS ema12, {r('er.e26')} AS ema26
FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
""")
def w4_ema_frame(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    p = ind.ema_recursive_multi(p, "close", [2.0 / 13.0, 2.0 / 27.0], ["ema12", "ema26"])
    return rounded(p.select("symbol", "date", "ema12", "ema26"))


@register("w5_macd", WR("prices") + _ema_ctes("prices") + f"""
SELECT eb.symbol, eb.date, {r('er.e12 - er.e26', 3)} AS macd
FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
""")
def w5_macd(spark, sf_dir):
    p = ind.macd(FX.prices(spark, sf_dir).select("symbol", "date", "close"), "close")
    return rounded(p.select("symbol", "date", "macd"), 3)


@register("w6_ema_adjusted", WR("prices") + _ema_ctes("prices") + f"""
SELECT eb.symbol, eb.date, {r('er.an / er.ad')} AS ema
FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
""")
def w6_ema_adjusted(spark, sf_dir):
    p = ind.ema_adjusted(FX.prices(spark, sf_dir).select("symbol", "date", "close"), "close", com=0.5, out="ema")
    return rounded(p.select("symbol", "date", "ema"))


# ---------------------------------------------------------------- alignment / fill
GRID_SQL = """,
bounds AS (SELECT symbol, min(date) AS d0, max(date) AS d1 FROM prices GROUP BY 1),
grid AS (SELECT symbol, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
         FROM bounds),
aligned AS (SELECT g.symbol, g.date, p.close FROM grid g LEFT JOIN prices p ON g.symbol = p.symbol AND g.date = p.date)"""


def _aligned(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    grid = (p.groupBy("symbol").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
            .select("symbol", F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("date")))
    return J.align_to_dates(p, grid)


@register("j2_align_to_dates", W("prices") + GRID_SQL + f"""
SELECT symbol, date, {r('close')} AS close FROM aligned
""")
def j2_align_to_dates(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir))


@register("w9_forward_fill", W("prices") + GRID_SQL + f"""
SELECT symbol, date,
  {r('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS close
FROM aligned
""")
def w9_forward_fill(spark, sf_dir):
    return rounded(ind.forward_fill(_aligned(spark, sf_dir), ["close"]))


@register("j3_outer_by_date", W("scored_posts", "prices") + f""",
pos AS (SELECT symbol, CAST(ts AS DATE) AS date, avg(compound) AS compound
        FROM scored_posts WHERE compound <> 0 GROUP BY 1, 2)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date,
       {r('a.compound')} AS compound, {r('b.close')} AS close
FROM pos a FULL OUTER JOIN (SELECT symbol, date, close FROM prices) b ON a.symbol = b.symbol AND a.date = b.date
""")
def j3_outer_by_date(spark, sf_dir):
    sp = P.scored_posts(spark, sf_dir).filter(F.col("compound") != 0)
    a = P.daily_sentiment(sp)
    b = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    return rounded(J.outer_by_date(a, b))


# ---------------------------------------------------------------- warm-up, long form
@register("f5_drop_warmup", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close, CAST(rn - 20 AS BIGINT) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM prices) WHERE rn > 20
""")
def f5_drop_warmup(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    return rounded(FL.drop_warmup(p, 20))


@register("f7_to_series", W("daily") + f""",
fw AS (SELECT symbol, date, close,
         CASE WHEN count(close) OVER w7 = 7 THEN avg(close) OVER w7 END AS ma7,
         CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS ma20
       FROM daily
       WINDOW w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
              w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, date, variable, {r('value')} AS value FROM (
  SELECT symbol, date, 'ma7' AS variable, ma7 AS value FROM fw
  UNION ALL SELECT symbol, date, 'close', close FROM fw
  UNION ALL SELECT symbol, date, 'ma20', ma20 FROM fw)
""")
def f7_to_series(spark, sf_dir):
    f = P.daily_features(spark, sf_dir)
    return rounded(FL.to_series(f, ["symbol", "date"], ["ma7", "close", "ma20"]))


# ---------------------------------------------------------------- scaling
SCALE_COLS = ["open", "close", "volume"]


def _scale_sql(x):
    return (f"(CAST({x} AS DOUBLE) - min(CAST({x} AS DOUBLE)) OVER s) * ({dbl(2.0)} / CASE WHEN max(CAST({x} AS DOUBLE)) OVER s"
            f" - min(CAST({x} AS DOUBLE)) OVER s = 0 THEN {dbl(1.0)} ELSE max(CAST({x} AS DOUBLE)) OVER s - min(CAST({x} AS DOUBLE)) OVER s END)"
            f" + {dbl(-1.0)}")


@register("n1_fit_minmax", W("prices") + f"""
SELECT symbol, feature, {r('data_min')} AS data_min, {r('data_max')} AS data_max,
       {dbl(-1.0)} AS lo, {dbl(1.0)} AS hi FROM (
  SELECT symbol, 'open' AS feature, min(open) AS data_min, max(open) AS data_max FROM prices GROUP BY 1
  UNION ALL SELECT symbol, 'close', min(close), max(close) FROM prices GROUP BY 1
  UNION ALL SELECT symbol, 'volume', CAST(min(volume) AS DOUBLE), CAST(max(volume) AS DOUBLE) FROM prices GROUP BY 1)
""")
def n1_fit_minmax(spark, sf_dir):
    return rounded(SC.fit_minmax(FX.prices(spark, sf_dir), SCALE_COLS))


@register("n2_apply_minmax", W("prices") + f"""
SELECT symbol, date, {r(_scale_sql('open'))} AS open, {r(_scale_sql('close'))} AS close,
       {r(_scale_sql('volume'))} AS volume
FROM prices WINDOW s AS (PARTITION BY symbol)
""")
def n2_apply_minmax(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", *SCALE_COLS)
    scaler = SC.fit_minmax(p, SCALE_COLS)
    return rounded(SC.apply_minmax(p, scaler, SCALE_COLS))


@register("n4_invert_minmax", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close FROM prices
""")
def n4_invert_minmax(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    scaler = SC.fit_minmax(p, ["close"])
    s = SC.apply_minmax(p, scaler, ["close"])
    return rounded(SC.invert_minmax(s, scaler, "close", "close").select("symbol", "date", "close"))


# ---------------------------------------------------------------- sequences and splits
def _price_sequences(spark, sf_dir, horizon=1):
    p = FX.prices(spark, sf_dir)
    seq = SQ.make_sequences(p, SCALE_COLS, "close", 5, horizon)
    return SQ.split_last(seq, 20)


def _rlist(c):
    return F.transform(c, lambda v: round_half_up(v, 6))


PSEQ_SQL = f""",
pb AS (SELECT symbol, date, row_number() OVER w - 1 AS sample, count(*) OVER w5 AS nx,
              list([CAST(open AS DOUBLE), CAST(close AS DOUBLE), CAST(volume AS DOUBLE)]) OVER w5 AS xs,
              list(close) OVER w5 AS yc, last_value(close) OVER w5 AS last_close,
              lead(date, 5) OVER w AS d1, lead(date, 6) OVER w AS d2, lead(date, 7) OVER w AS d3,
              lead(close, 5) OVER w AS y1, lead(close, 6) OVER w AS y2, lead(close, 7) OVER w AS y3
       FROM prices
       WINDOW w AS (PARTITION BY symbol ORDER BY date),
              w5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""


def _pseq_split(h):
    last = {1: "d1", 3: "d3"}[h]
    return f""",
ps AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY sample DESC) <= 20
                      THEN 'test' ELSE 'train' END AS split
       FROM pb WHERE nx = 5 AND {last} IS NOT NULL)"""


@register("w10_sequences", W("prices") + PSEQ_SQL + _pseq_split(1) + f"""
SELECT symbol, sample, date AS start_date, d1 AS target_date,
       list_transform(flatten(xs), lambda v: {r('v')}) AS x,
       {r('y1')} AS y, list_transform(yc, lambda v: {r('v')}) AS yc
FROM ps
""")
def w10_sequences(spark, sf_dir):
    s = _price_sequences(spark, sf_dir)
    return s.select("symbol", F.col("sample").cast("bigint").alias("sample"), "start_date", "target_date",
                    _rlist(F.flatten("x")).alias("x"), round_half_up(F.col("y")[0]).alias("y"),
                    _rlist(F.col("yc")).alias("yc"))


@register("w11_split_last", W("prices") + PSEQ_SQL + _pseq_split(1) + """
SELECT symbol, sample, split FROM ps
""")
def w11_split_last(spark, sf_dir):
    return _price_sequences(spark, sf_dir).select("symbol", "sample", "split")


@register("w12_target_dates", W("prices") + PSEQ_SQL + _pseq_split(1) + """
SELECT DISTINCT symbol, split, d1 AS date FROM ps
""")
def w12_target_dates(spark, sf_dir):
    return SQ.target_dates(_price_sequences(spark, sf_dir))


@register("m1_hash_split", W("posts") + f"""
SELECT post_id, CASE WHEN row_number() OVER (
           ORDER BY ('0x' || substr(md5('42:' || CAST(post_id AS VARCHAR)), 1, 15))::BIGINT, post_id)
         <= ceil(count(*) OVER () * {dbl(0.2)}) THEN 'test' ELSE 'train' END AS split
FROM posts
""")
def m1_hash_split(spark, sf_dir):
    p = FX.posts(spark, sf_dir, with_text=False).select("post_id")
    return SQ.hash_split(p, "post_id", 0.2, 42)


# ---------------------------------------------------------------- evaluation
def _persistence(spark, sf_dir, h):
    return EV.persistence_forecast(_price_sequences(spark, sf_dir, h), h)


@register("m7_persistence_forecast", W("prices") + PSEQ_SQL + _pseq_split(1) + f"""
SELECT symbol, sample, split, {r('last_close')} AS pred, {r('y1')} AS y FROM ps
""")
def m7_persistence_forecast(spark, sf_dir):
    d = _persistence(spark, sf_dir, 1)
    return rounded(d.select("symbol", "sample", "split", F.col("pred")[0].alias("pred"), F.col("y")[0].alias("y")))


PL3 = _pseq_split(3) + """,
pl AS (SELECT symbol, split, d1 AS date, y1 AS y, last_close AS pred FROM ps
       UNION ALL SELECT symbol, split, d2, y2, last_close FROM ps
       UNION ALL SELECT symbol, split, d3, y3, last_close FROM ps)"""


@register("a7_mean_by_target_date", W("prices") + PSEQ_SQL + PL3 + f"""
SELECT symbol, split, date, {r('avg(pred)')} AS pred_mean FROM pl GROUP BY 1, 2, 3
""")
def a7_mean_by_target_date(spark, sf_dir):
    d = _persistence(spark, sf_dir, 3)
    return rounded(EV.mean_by_target_date(d, "pred", keys=("symbol", "split")))


@register("a14_rmse", W("prices") + PSEQ_SQL + _pseq_split(1) + f"""
SELECT symbol, split, {r('sqrt(avg((last_close - y1) * (last_close - y1)))')} AS rmse, count(last_close - y1) AS n
FROM ps GROUP BY 1, 2
""")
def a14_rmse(spark, sf_dir):
    d = _persistence(spark, sf_dir, 1).select("symbol", "split", F.col("pred")[0].alias("predicted"),
                                               F.col("y")[0].alias("real"))
    return rounded(EV.rmse(d, by=("symbol", "split")))


@register("a15_nrmse", W("prices") + PSEQ_SQL + _pseq_split(1) + f"""
SELECT symbol, split, {r('sqrt(avg((last_close - y1) * (last_close - y1))) / nullif(avg(y1), 0)')} AS nrmse
FROM ps GROUP BY 1, 2
""")
def a15_nrmse(spark, sf_dir):
    d = _persistence(spark, sf_dir, 1).select("symbol", "split", F.col("pred")[0].alias("predicted"),
                                               F.col("y")[0].alias("real"))
    return rounded(EV.nrmse(d, by=("symbol", "split")))


@register("m10_evaluate_forecast", W("prices") + PSEQ_SQL + PL3 + f""",
pm AS (SELECT symbol, split, date, avg(pred) AS predicted FROM pl GROUP BY 1, 2, 3),
rm AS (SELECT symbol, split, date, avg(y) AS real FROM pl GROUP BY 1, 2, 3),
pr AS (SELECT coalesce(pm.symbol, rm.symbol) AS symbol, coalesce(pm.split, rm.split) AS split, predicted, real
       FROM pm FULL OUTER JOIN rm ON pm.symbol = rm.symbol AND pm.split = rm.split AND pm.date = rm.date)
SELECT symbol, split, {r('sqrt(avg((predicted - real) * (predicted - real)))')} AS rmse,
       count(predicted - real) AS n FROM pr GROUP BY 1, 2
""")
def m10_evaluate_forecast(spark, sf_dir):
    return rounded(EV.evaluate_forecast(_persistence(spark, sf_dir, 3)))


# The report over a table lab(t, p) of true and predicted classes.
REPORT_SQL = f"""
pc AS (SELECT 'Negative' AS name, count(*) FILTER (WHERE t = 0 AND p = 0) AS tp,
              count(*) FILTER (WHERE t = 0) AS sup, count(*) FILTER (WHERE p = 0) AS np FROM lab
       UNION ALL
       SELECT 'Neutral', count(*) FILTER (WHERE t = 1 AND p = 1), count(*) FILTER (WHERE t = 1),
              count(*) FILTER (WHERE p = 1) FROM lab
       UNION ALL
       SELECT 'Positive', count(*) FILTER (WHERE t = 2 AND p = 2), count(*) FILTER (WHERE t = 2),
              count(*) FILTER (WHERE p = 2) FROM lab),
m1 AS (SELECT name, CASE WHEN np = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) END AS prec,
              CASE WHEN sup = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(sup AS DOUBLE) END AS rec, sup FROM pc),
m2 AS (SELECT name, prec, rec, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1, sup FROM m1),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE t = p) AS ok FROM lab)
SELECT name AS class, {r('prec')} AS precision, {r('rec')} AS recall, {r('f1')} AS f1, sup AS support FROM m2
UNION ALL SELECT 'accuracy', {r('CAST(ok AS DOUBLE) / n')}, {r('CAST(ok AS DOUBLE) / n')}, {r('CAST(ok AS DOUBLE) / n')}, n FROM tot
UNION ALL SELECT 'macro avg', {r('avg(prec)')}, {r('avg(rec)')}, {r('avg(f1)')}, max(tot.n) FROM m2, tot
UNION ALL SELECT 'weighted avg', {r('sum(prec * sup) / max(tot.n)')}, {r('sum(rec * sup) / max(tot.n)')},
                 {r('sum(f1 * sup) / max(tot.n)')}, max(tot.n) FROM m2, tot
"""


@register("a16_classification_report", W("scores") + f""",
lab AS (SELECT CASE WHEN compound <= 0.4 THEN 0 WHEN compound <= 0.6 THEN 1 ELSE 2 END AS t,
               CASE WHEN compound < 0 THEN 0 WHEN compound > 0 THEN 2 ELSE 1 END AS p FROM scores),
""" + REPORT_SQL)
def a16_classification_report(spark, sf_dir):
    s = P.document_scores(spark, sf_dir)
    lab = s.select(TX.threshold_label("compound").alias("label"),
                   F.when(F.col("compound") < 0, 0).when(F.col("compound") > 0, 2).otherwise(1)
                   .cast("bigint").alias("prediction"))
    return rounded(EV.classification_report(lab))


# ---------------------------------------------------------------- full dataset
def _m9_sql():
    feats = P.FEATURES
    ff = ",\n  ".join(f"last_value({f} IGNORE NULLS) OVER wf AS {f}" for f in feats)
    sc = ",\n  ".join(f"{_scale_sql(f)} AS {f}" for f in feats)
    arr = ", ".join(feats)
    return WR("daily") + _ema_ctes("daily") + f""",
fe AS (SELECT eb.symbol, eb.date, eb.rn, eb.compound, eb.open, eb.close, eb.high, eb.low,
              CAST(eb.volume AS DOUBLE) AS volume,
              CASE WHEN count(eb.close) OVER w7 = 7 THEN avg(eb.close) OVER w7 END AS ma7,
              CASE WHEN count(eb.close) OVER w20 = 20 THEN avg(eb.close) OVER w20 END AS ma20,
              er.e12 - er.e26 AS macd,
              CASE WHEN count(eb.close) OVER w20 = 20 THEN avg(eb.close) OVER w20 + 2.0 * stddev_samp(eb.close) OVER w20 END AS upper_band,
              CASE WHEN count(eb.close) OVER w20 = 20 THEN avg(eb.close) OVER w20 - 2.0 * stddev_samp(eb.close) OVER w20 END AS lower_band,
              er.an / er.ad AS ema,
              CASE WHEN eb.close / lag(eb.close) OVER w > 0 THEN ln(eb.close / lag(eb.close) OVER w) END AS log_momentum
       FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
       WINDOW w AS (PARTITION BY eb.symbol ORDER BY eb.date),
              w7 AS (PARTITION BY eb.symbol ORDER BY eb.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
              w20 AS (PARTITION BY eb.symbol ORDER BY eb.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ffl AS (SELECT symbol, date, {ff}
        FROM fe WHERE rn > 20
        WINDOW wf AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
scl AS (SELECT symbol, date, {sc},
          {_scale_sql('close')} AS target
        FROM ffl WINDOW s AS (PARTITION BY symbol)),
sq AS (SELECT symbol, date, row_number() OVER w - 1 AS sample, count(*) OVER w5 AS nx,
              list([{arr}]) OVER w5 AS xs, list(target) OVER w5 AS yc,
              lead(target, 5) OVER w AS y, lead(date, 5) OVER w AS target_date
       FROM scl WINDOW w AS (PARTITION BY symbol ORDER BY date),
                       w5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sp2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY sample DESC) <= 20
                       THEN 'test' ELSE 'train' END AS split
        FROM sq WHERE nx = 5 AND target_date IS NOT NULL)
SELECT symbol, sample, date AS start_date, target_date, split,
       list_transform(flatten(xs), lambda v: {r('v')}) AS x, {r('y')} AS y,
       list_transform(yc, lambda v: {r('v')}) AS yc
FROM sp2
"""


@register("m9_build_dataset", _m9_sql())
def m9_build_dataset(spark, sf_dir):
    s = P.build_dataset(spark, sf_dir)
    return s.select("symbol", "sample", "start_date", "target_date", "split",
                    _rlist(F.flatten("x")).alias("x"), round_half_up(F.col("y")[0]).alias("y"),
                    _rlist(F.col("yc")).alias("yc"))




@register("w3_bucketed_features", W("prices") + f"""
SELECT symbol, date,
  {r('CASE WHEN count(close) OVER w7 = 7 THEN avg(close) OVER w7 END')} AS ma7,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END')} AS ma20,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 + 2.0 * stddev_samp(close) OVER w20 END')} AS upper_band,
  {r('CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 - 2.0 * stddev_samp(close) OVER w20 END')} AS lower_band,
  {r('CASE WHEN close / lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END')} AS log_return
FROM prices
WINDOW w AS (PARTITION BY symbol ORDER BY date),
       w7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def w3_bucketed_features(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    out = ind.moving_features_bucketed(p, "close")
    return rounded(out.select("symbol", "date", "ma7", "ma20", "upper_band", "lower_band", "log_return"))


@register("w4_ema_bucketed", WR("prices") + _ema_ctes("prices") + f"""
SELECT eb.symbol, eb.date, {r('er.e12')} AS ema12, {r('er.e26')} AS ema26
FROM eb JOIN er ON eb.symbol = er.symbol AND eb.rn = er.rn
""")
def w4_ema_bucketed(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    p = ind.ema_bucketed(p, "close", [2.0 / 13.0, 2.0 / 27.0], ["ema12", "ema26"])
    return rounded(p.select("symbol", "date", "ema12", "ema26"))


@register("w10_sequences_bucketed", W("prices") + PSEQ_SQL + _pseq_split(1) + f"""
SELECT symbol, sample, date AS start_date, d1 AS target_date,
       list_transform(flatten(xs), lambda v: {r('v')}) AS x,
       {r('y1')} AS y, list_transform(yc, lambda v: {r('v')}) AS yc
FROM ps
""")
def w10_sequences_bucketed(spark, sf_dir):
    p = FX.prices(spark, sf_dir)
    s = SQ.make_sequences_bucketed(p, SCALE_COLS, "close", 5, 1)
    return s.select("symbol", F.col("sample").cast("bigint").alias("sample"), "start_date", "target_date",
                    _rlist(F.flatten("x")).alias("x"), round_half_up(F.col("y")[0]).alias("y"),
                    _rlist(F.col("yc")).alias("yc"))


# ---------------------------------------------------------------- the same steps without a whole series in one task
@register("w6_ema_adjusted_bucketed", ORACLE["w6_ema_adjusted"])
def w6_ema_adjusted_bucketed(spark, sf_dir):
    p = ind.ema_adjusted_bucketed(FX.prices(spark, sf_dir).select("symbol", "date", "close"), "close", com=0.5, out="ema")
    return rounded(p.select("symbol", "date", "ema"))


@register("w9_forward_fill_carried", ORACLE["w9_forward_fill"])
def w9_forward_fill_carried(spark, sf_dir):
    return rounded(CA.forward_fill_carried(_aligned(spark, sf_dir), ["close"]))


@register("w11_split_last_carried", ORACLE["w11_split_last"])
def w11_split_last_carried(spark, sf_dir):
    seq = SQ.make_sequences_bucketed(FX.prices(spark, sf_dir), ["close"], "close", 5, 1)
    return CA.split_last_carried(seq, 20, bucket_rows=500).select("symbol", "sample", "split")


@register("w13_with_position_carried", ORACLE["w13_with_position"])
def w13_with_position_carried(spark, sf_dir):
    return CA.with_position_carried(FX.prices(spark, sf_dir)).select("symbol", "date", "pos")


@register("f5_drop_warmup_carried", ORACLE["f5_drop_warmup"])
def f5_drop_warmup_carried(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    return rounded(CA.drop_warmup_carried(p, 20))


@register("m9_build_dataset_bucketed", ORACLE["m9_build_dataset"])
def m9_build_dataset_bucketed(spark, sf_dir):
    s = P.build_dataset(spark, sf_dir, bucket=F.year("date"))
    return s.select("symbol", "sample", "start_date", "target_date", "split",
                    _rlist(F.flatten("x")).alias("x"), round_half_up(F.col("y")[0]).alias("y"),
                    _rlist(F.col("yc")).alias("yc"))
