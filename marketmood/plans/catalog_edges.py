"""Registered queries on rows that are awkward: missing and repeated ids, NaN, keys that aren't text."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.operators import indicators as ind
from marketmood.operators import ml as ML
from marketmood.operators import rollups as R
from marketmood.operators import sequences as SQ
from marketmood.operators import text_ops as TO
from marketmood.plans import catalog_io as CI
from marketmood.plans import catalog_ml as CM
from marketmood.plans.catalog import W, _describe_sql, _hist_sql, r, register, rounded
from marketmood.plans.catalog_series import GRID_SQL, _aligned
from marketmood.plans.oracle_sql import LEMMA_CTE
from marketmood.sources import fixtures as FX
from marketmood.sources.readers import read_table

# NaN and NULL among the prices of orders.
GAPS_SQL = """gaps AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN NULL
                     ELSE o_totalprice END AS price, o_orderkey % 3 AS part FROM orders),
whole AS (SELECT * FROM gaps WHERE price IS NOT NULL AND NOT isnan(price))"""


def _gaps(spark, sf_dir):
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, None).otherwise(F.col("o_totalprice"))
    return read_table(spark, sf_dir, "orders").select(price.alias("price"), (k % 3).alias("part"))


@register("a8_describe_missing", "WITH " + GAPS_SQL + _describe_sql(["price"], "whole"))
def a8_describe_missing(spark, sf_dir):
    return rounded(R.describe_numeric(_gaps(spark, sf_dir), ["price"]))


@register("a9_histogram_missing", "WITH " + GAPS_SQL + ",\n" + _hist_sql("whole", "price", 30))
def a9_histogram_missing(spark, sf_dir):
    return rounded(R.histogram(_gaps(spark, sf_dir), "price", 30))


@register("a10_histogram_missing", "WITH " + GAPS_SQL + ",\n" + _hist_sql("whole", "price", 12, by="part"))
def a10_histogram_missing(spark, sf_dir):
    return rounded(R.histogram(_gaps(spark, sf_dir), "price", 12, by="part"))


@register("w9_forward_fill_missing", W("prices") + GRID_SQL + f"""
SELECT symbol, date,
  {r('last_value(CASE WHEN day(date) % 5 <> 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date '
     'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS close
FROM aligned
""")
def w9_forward_fill_missing(spark, sf_dir):
    d = _aligned(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("date") % 5 == 0, float("nan")).otherwise(F.col("close")))
    return rounded(ind.forward_fill(d, ["close"]))


# Ids that repeat, and a third of the rows without one.
ID_SQL = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 50 END"


def _repeated(df):
    return df.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50))


@register("t3_lemmatise_repeats", "WITH " + LEMMA_CTE + """,
k AS (SELECT doc_id, regexp_extract_all(lower(text), '""" + CM.TOKEN_RE + """') AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM k),
g AS (SELECT e.doc_id, list(coalesce(l.lemma, e.tok) ORDER BY e.pos) AS lem
      FROM e LEFT JOIN lemmas l ON e.tok = l.form GROUP BY e.doc_id)
SELECT """ + ID_SQL.replace("doc_id", "k.doc_id") + """ AS doc_id, md5(array_to_string(coalesce(g.lem, []), ' ')) AS lemmas
FROM k LEFT JOIN g ON k.doc_id = g.doc_id
""")
def t3_lemmatise_repeats(spark, sf_dir):
    lem = TO.lemmatise(_repeated(CM._words(spark, sf_dir)), FX.lemmas(spark), "doc_id", "tokens", "l")
    return lem.select("doc_id", F.md5(F.array_join("l", " ")).alias("lemmas"))


@register("t13_encode_repeats", "WITH " + CM.KEPT_SQL + ",\n" + CM.VOCAB_SQL + f""",
twice AS (SELECT doc_id AS row_id, {ID_SQL} AS doc_id, toks FROM k UNION ALL SELECT -1 - doc_id, {ID_SQL}, toks FROM k WHERE doc_id % 4 = 0),
e AS (SELECT row_id, unnest(toks[1:18]) AS tok, unnest(range(1, len(toks[1:18]) + 1)) AS pos FROM twice),
g AS (SELECT e.row_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN v ON e.tok = v.token GROUP BY e.row_id),
f AS (SELECT doc_id, list_concat([CAST(2 AS BIGINT)], coalesce(g.ids, []), [CAST(3 AS BIGINT)]) AS ids
      FROM twice LEFT JOIN g ON twice.row_id = g.row_id)
SELECT doc_id, list_concat(ids, list_transform(range(20 - len(ids)), lambda x: CAST(0 AS BIGINT))) AS input_ids FROM f
""")
def t13_encode_repeats(spark, sf_dir):
    kept = CM._kept(spark, sf_dir)
    vocab = TO.build_vocab(kept, "tokens", 1000)
    rows = _repeated(kept.unionByName(kept.filter(F.col("doc_id") % 4 == 0)))
    return TO.encode_tokens(rows, vocab, "doc_id", "tokens", 20).select("doc_id", "input_ids")


@register("m5_integer_keys", W("prices") + CI.LINE_SQL.replace("FROM prices WINDOW", """FROM (
        SELECT CASE WHEN symbol <> '5-LOW' THEN CAST(left(symbol, 1) AS INTEGER) END AS symbol, date, close FROM prices) WINDOW""") + f"""
SELECT symbol, n_train, {r('a')} AS intercept, {r('b')} AS slope FROM fit
""")
def m5_integer_keys(spark, sf_dir):
    key = F.when(F.col("symbol") != "5-LOW", F.substring("symbol", 1, 1).cast("int"))
    p = FX.prices(spark, sf_dir).select(key.alias("symbol"), "date", (F.col("close") / 1e5).alias("close"))
    seq = SQ.split_last(SQ.make_sequences(p, ["close"], "close", 1, 1), 20)
    coefs = ML.fit_forecaster(seq, ridge=0.0)
    return rounded(coefs.select("symbol", "n_train", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")))


# Of letters with accents, decomposition leaves the letter when the marks are taken out.
@register("t7_nfkd_accents", """
SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents
""")
def t7_nfkd_accents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.regexp_replace(TX.nfkd("text"), "\\p{Mn}", "")).alias("plain_md5"))
