"""Registered queries, phase 4: redaction and size rollups (G1-G3, G5, G6), streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.operators import redact as RD
from marketmood.plans import pipeline as P
from marketmood.plans.catalog import W, r, register, rounded
from marketmood.plans.oracle_sql import LEX_CTE, sentiment_ctes
from marketmood.session import shared_path, store
from marketmood.sources import fixtures as FX
from marketmood.sources.readers import read_table, read_text_table
from marketmood.streaming import live as LV

# --- fixed values -----------------------------------------------------------
# Demo replacement rules for the documents table (personal data, secrets,
# license lines that occur in it).
REDACTION_RULES = [
    "literal:Licensed under the Apache License, Version 2.0.==>[LICENSE]",
    'regex:token = "[0-9a-f]{40}"==>token = "[SECRET]"',
    "regex:[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+==>[EMAIL]",
    "regex:[0-9]{1,3}(\\.[0-9]{1,3}){3}",
    "glob:mail?.example.com==>[MAILHOST]",
]
# Demo path rules for page names (host + path).
PATH_GLOBS = ["*/en/*.html"]
PATH_REGEXES = ["/fr/[0-9]+/?$"]
PATH_MATCHES = ["thther.example.org"]
PATH_RENAMES = [("thther.example.org/en", "thther.example.org/english")]
PATH_REGEX_RENAMES = [("^(m|blog)\\.", "")]
MAX_DOC_BYTES = 20000
# --- end of fixed values ----------------------------------------------------

NAME_RE = "^[a-zA-Z]+://([^?#]*)"


def _pages(spark, sf_dir):
    p = read_text_table(spark, sf_dir, "pages", "page_id")
    return p.select("page_id", F.regexp_extract("url", NAME_RE, 1).alias("name"),
                    F.octet_length("html").cast("bigint").alias("size"), "html")


# The oracle states every rule by hand: the literal one first, then the patterns in order.
@register("g1_redact", r"""
WITH a AS (SELECT doc_id, text, replace(text, 'Licensed under the Apache License, Version 2.0.', '[LICENSE]') AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(t, 'token = "[0-9a-f]{40}"', 'token = "[SECRET]"', 'g') AS t FROM a),
c AS (SELECT doc_id, text, regexp_replace(t, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g') AS t FROM b),
d AS (SELECT doc_id, text, regexp_replace(t, '[0-9]{1,3}(\.[0-9]{1,3}){3}', '***REMOVED***', 'g') AS t FROM c),
e AS (SELECT doc_id, text, regexp_replace(t, 'mail(?s:.)\.example\.com', '[MAILHOST]', 'g') AS t FROM d)
SELECT doc_id, CASE WHEN contains(text, chr(0)) AND strlen(split_part(text, chr(0), 1)) < 8192 THEN text ELSE t END AS redacted
FROM e
""")
def g1_redact(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", RD.redact("text", REDACTION_RULES).alias("redacted"))


@register("g2_strip_items", f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents
WHERE strlen(text) <= {MAX_DOC_BYTES} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def g2_strip_items(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    toxic = read_table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    kept = RD.strip_items(d, "text", MAX_DOC_BYTES, toxic, "doc_id")
    return kept.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@register("g3_size_rollup", f"""
WITH pg AS (SELECT regexp_extract(url, '{NAME_RE}', 1) AS name, CAST(strlen(html) AS BIGINT) AS size FROM pages),
sp AS (SELECT string_split(name, '/') AS parts, size FROM pg),
dk AS (SELECT parts, size, unnest(range(1, len(parts))) AS k FROM sp),
ks AS (SELECT 'path' AS kind, name AS key, size FROM pg
       UNION ALL SELECT 'extension', regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1), size FROM pg
       UNION ALL SELECT 'directory', array_to_string(parts[1:k], '/'), size FROM dk
       UNION ALL SELECT 'directory', '', size FROM pg)
SELECT kind, key, CAST(sum(size) AS BIGINT) AS size, count(*) AS n FROM ks GROUP BY 1, 2
""")
def g3_size_rollup(spark, sf_dir):
    return RD.size_rollup(_pages(spark, sf_dir), "name", "size")


@register("g5_content_groups", """
WITH d AS (SELECT md5(text) AS content_id, CAST(doc_id AS VARCHAR) AS name, CAST(strlen(text) AS BIGINT) AS size
           FROM documents)
SELECT d.content_id, d.name, d.size, c.n_names
FROM d JOIN (SELECT content_id, count(*) AS n_names FROM d GROUP BY 1) c ON d.content_id = c.content_id
""")
def g5_content_groups(spark, sf_dir):
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return RD.content_groups(d, "doc_id", "text")


@register("g6_select_paths", f"""
WITH pg AS (SELECT page_id, regexp_extract(url, '{NAME_RE}', 1) AS name FROM pages),
kept AS (SELECT page_id, name FROM pg
         WHERE name = 'thther.example.org' OR starts_with(name, 'thther.example.org/')
            OR (contains(name, '/en/') AND ends_with(name, '.html') AND position('/en/' IN name) + 4 <= length(name) - 4)
            OR regexp_matches(name, '/fr/[0-9]+/?$')),
moved AS (SELECT page_id, CASE WHEN name = 'thther.example.org/en' OR starts_with(name, 'thther.example.org/en/')
                               THEN 'thther.example.org/english' || substr(name, 22) ELSE name END AS name FROM kept)
SELECT page_id, CASE WHEN starts_with(name, 'm.') THEN substr(name, 3) WHEN starts_with(name, 'blog.') THEN substr(name, 6)
                     ELSE name END AS name FROM moved
""")
def g6_select_paths(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", "name")
    return RD.select_paths(p, "name", match=PATH_MATCHES, glob=PATH_GLOBS, regex=PATH_REGEXES,
                           renames=PATH_RENAMES, regex_renames=PATH_REGEX_RENAMES)


# ---------------------------------------------------------------- streaming
@register("x1_live_bars", """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, row(ts, value)) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, row(ts, value)) AS close, count(*) AS volume
FROM events GROUP BY 1, 2
""")
def x1_live_bars(spark, sf_dir):
    live = LV.LiveTable(spark, shared_path(spark, "live-bars"), LV.bar_parts("ts", "event_type", "value"), LV.merge_bar_parts)
    return LV.bars_of(live.run(LV.table_stream(spark, sf_dir, "events.parquet")).table())


@register("x2_live_sentiment", W("scored_posts") + f"""
SELECT symbol, CAST(ts AS DATE) AS date, {r('avg(compound)')} AS compound, count(*) AS n_posts
FROM scored_posts GROUP BY 1, 2
""")
def x2_live_sentiment(spark, sf_dir):
    """Orders stream in as posts; the texts that a micro-batch mentions are scored in it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.count()
    orders = LV.table_stream(spark, sf_dir, "orders.parquet")
    posts = orders.select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("symbol"),
                          (F.col("o_orderkey") % F.lit(n_docs)).alias("doc_id"))
    live = LV.LiveTable(spark, shared_path(spark, "live-sentiment"), LV.sentiment_parts(FX.lexicon(spark), texts=docs),
                        LV.merge_sentiment_parts)
    return rounded(LV.sentiment_of(live.run(posts).table()))


# ---------------------------------------------------------------- dates, sorts, sinks
@register("d2_parse_date", """
SELECT o_orderkey AS post_id, CAST(o_orderdate AS DATE) AS day FROM orders
""")
def d2_parse_date(spark, sf_dir):
    from marketmood.functions.dates import parse_date
    o = read_table(spark, sf_dir, "orders")
    s = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("post_id"), parse_date(s).alias("day"))


@register("k1_sort_daily", W("prices") + f"""
SELECT symbol, date, {r('close')} AS close FROM prices ORDER BY symbol, date
""")
def k1_sort_daily(spark, sf_dir):
    p = FX.prices(spark, sf_dir).select("symbol", "date", "close")
    return rounded(p.orderBy("symbol", "date"))


@register("s3_write_read_posts", W("posts") + """
SELECT post_id, ts, symbol, doc_id FROM posts
""")
def s3_write_read_posts(spark, sf_dir):
    from marketmood.sources.readers import write_posts
    path = shared_path(spark, "posts")
    write_posts(FX.posts(spark, sf_dir, with_text=False), path, fmt="parquet", partition_by="symbol")
    return spark.read.parquet(path).select("post_id", "ts", "symbol", "doc_id")


@register("s4_scaler_round_trip", W("prices") + f"""
SELECT symbol, feature, {r('data_min')} AS data_min, {r('data_max')} AS data_max,
       CAST('-1.0' AS DOUBLE) AS lo, CAST('1.0' AS DOUBLE) AS hi FROM (
  SELECT symbol, 'close' AS feature, min(close) AS data_min, max(close) AS data_max FROM prices GROUP BY 1
  UNION ALL SELECT symbol, 'volume', CAST(min(volume) AS DOUBLE), CAST(max(volume) AS DOUBLE) FROM prices GROUP BY 1)
""")
def s4_scaler_round_trip(spark, sf_dir):
    from marketmood.operators.scaling import fit_minmax
    from marketmood.sources.readers import load_scaler, save_scaler
    path = shared_path(spark, "scaler")
    save_scaler(fit_minmax(FX.prices(spark, sf_dir), ["close", "volume"]), path)
    return rounded(load_scaler(spark, path))


@register("d6_argmax", W("scores") + """
SELECT doc_id, CAST(list_position([neg, neu, pos], list_max([neg, neu, pos])) - 1 AS BIGINT) AS class_index
FROM scores
""")
def d6_argmax(spark, sf_dir):
    from marketmood.functions.numeric import argmax
    s = P.document_scores(spark, sf_dir)
    return s.select("doc_id", argmax(F.array("neg", "neu", "pos")).alias("class_index"))


@register("t6_distinct_text_scores", W("scores") + """
SELECT doc_id, neg, neu, pos, compound FROM scores
""")
def t6_distinct_text_scores(spark, sf_dir):
    from marketmood.operators.sentiment import score_distinct_texts
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return score_distinct_texts(docs, "text", "doc_id", FX.lexicon(spark))


# Phrase rows: frequent words of the documents are replaced by runs that the rules act on.
PHRASE_SWAPS = [(" of ", " never so best "), (" in ", " without doubt worthless "), (" it ", " Kiss of TRASH! "),
                (" that ", " clown, show "), (" is ", " never really this stupid of ")]
PHRASES = [("kiss of trash", -1.5), ("clown show", -3.0), ("so best the", 1.2), ("this stupid of", 0.4), ("trash the", 2.5)]
SWAPPED_SQL = "text"
for _a, _b in PHRASE_SWAPS:
    SWAPPED_SQL = f"replace({SWAPPED_SQL}, '{_a}', '{_b}')"


def _swapped(spark, sf_dir):
    text = F.col("text")
    for a, b in PHRASE_SWAPS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", text.alias("text"))


PHRASE_SQL = ("WITH " + LEX_CTE + f""",
idioms(phrase, valence) AS (VALUES {FX.sql_values(PHRASES)}),
swapped AS (SELECT doc_id, {SWAPPED_SQL} AS text FROM documents),
""" + sentiment_ctes("swapped", phrases="idioms") + "\nSELECT doc_id, neg, neu, pos, compound FROM scores")


@register("t6_phrase_scores", PHRASE_SQL)
def t6_phrase_scores(spark, sf_dir):
    from marketmood.operators.sentiment import score_sentiment
    table = FX.values_table(spark, PHRASES, T.StructType([T.StructField("phrase", T.StringType()),
                                                          T.StructField("valence", T.DoubleType())]))
    return score_sentiment(_swapped(spark, sf_dir), "text", "doc_id", FX.lexicon(spark), phrases=table)


@register("t6_phrase_scores_in_row", PHRASE_SQL)
def t6_phrase_scores_in_row(spark, sf_dir):
    from marketmood.operators.sentiment import score_in_row
    return score_in_row(_swapped(spark, sf_dir), "text", dict(FX.DEMO_LEXICON), phrases=dict(PHRASES)).drop("text")


# A lexicon of some thousand words: every 16th word of the documents (by its hash) with a valence from the hash.
LARGE_LEX_SQL = r"""
lw AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,12}')) AS token FROM documents)),
lex AS (SELECT token, CAST(((ascii(substr(md5(token), 2, 1)) * 16 + ascii(substr(md5(token), 3, 1))) % 79 - 39) AS DOUBLE) / 10.0 AS valence
        FROM lw WHERE substr(md5(token), 1, 1) = '0')"""


def _large_lexicon(spark, sf_dir):
    words = (read_text_table(spark, sf_dir, "documents", "doc_id")
             .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,12}"), 0)).alias("token")).distinct())
    code = lambda k: F.ascii(F.substring(F.md5("token"), k, 1))
    return words.filter(F.substring(F.md5("token"), 1, 1) == "0").select(
        "token", (((code(2) * 16 + code(3)) % 79 - 39).cast("double") / 10.0).alias("valence"))


@register("t6_large_lexicon", "WITH " + LARGE_LEX_SQL + ",\n" + sentiment_ctes()
          + "\nSELECT doc_id, neg, neu, pos, compound FROM scores")
def t6_large_lexicon(spark, sf_dir):
    docs = read_text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    from marketmood.operators.sentiment import score_sentiment
    # Scoring reads the lexicon more than once; it is made once.
    return score_sentiment(docs, "text", "doc_id", store(_large_lexicon(spark, sf_dir), "large-lexicon"))


@register("j5_lexicon_join", W("scores") + """
SELECT doc_id, neg, neu, pos, compound FROM scores
""")
def j5_lexicon_join(spark, sf_dir):
    return P.document_scores(spark, sf_dir, FX.lexicon(spark))


@register("a6_null_counts_prices", W("prices") + """
SELECT 'open' AS "column", count(*) FILTER (WHERE open IS NULL OR isnan(open)) AS nulls FROM prices
UNION ALL SELECT 'close', count(*) FILTER (WHERE close IS NULL OR isnan(close)) FROM prices
UNION ALL SELECT 'volume', count(*) FILTER (WHERE volume IS NULL) FROM prices
""")
def a6_null_counts_prices(spark, sf_dir):
    from marketmood.operators.rollups import null_counts
    return null_counts(FX.prices(spark, sf_dir), ["open", "close", "volume"])
