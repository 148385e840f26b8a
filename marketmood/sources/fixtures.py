"""Fixture views over the driver's tables.

The driver's synthetic tables have no stock data, so daily prices and posts
are derived from ``orders`` (order priority = symbol) and ``documents`` (the
post text). The same definitions exist as SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.sources import schemas
from marketmood.sources.readers import read_table

# --- fixed values -----------------------------------------------------------
# Demo sentiment lexicon (token, valence); valences are invented for tests,
# the words occur in the driver's ``documents`` table.
DEMO_LEXICON = [
    ("best", 3.2), ("worthless", -2.7), ("stupid", -2.4), ("idiot", -2.3),
    ("trash", -1.5), ("pathetic", -2.6), ("disgusting", -2.4), ("moron", -2.2),
    ("loser", -2.4), ("scum", -2.5), ("clown", -1.0),
]
# Demo lemma table (form, lemma).
DEMO_LEMMAS = [
    ("idiots", "idiot"), ("morons", "moron"), ("losers", "loser"),
    ("clowns", "clown"), ("documents", "document"), ("words", "word"),
]
# --- end of fixed values ----------------------------------------------------


def prices(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Daily OHLCV bars per symbol: ``(symbol, date, open, close, high, low, volume)``.

    ``start`` and ``end`` (dates, inclusive) are compared with the raw time
    stamp, so the range reaches the scan.

    A partial (map-side) aggregation per (priority, day); the shuffle carries
    one row per key and task, so it stays small at any scale.
    """
    o = read_table(spark, sf_dir, "orders")
    kind = o.schema["o_orderdate"].dataType
    if start is not None:
        o = o.filter(F.col("o_orderdate") >= F.lit(start).cast(kind))
    if end is not None:
        o = o.filter(F.col("o_orderdate") < F.date_add(F.lit(end), 1).cast(kind))
    return (o.groupBy(F.col("o_orderpriority").alias("symbol"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close"),
                 F.max("o_totalprice").alias("high"),
                 F.min("o_totalprice").alias("low"),
                 F.count(F.lit(1)).alias("volume")))


def posts(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Posts ``(post_id, ts, symbol, doc_id[, text])``: order k mentions document k mod n.

    Without text the result never touches the documents' text column, so the
    pipeline joins scores (one small row per document) instead of text.
    """
    o = read_table(spark, sf_dir, "orders")
    docs = read_table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    p = o.select(F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("ts"),
                 F.col("o_orderpriority").alias("symbol"), (F.col("o_orderkey") % n_docs).alias("doc_id"))
    if not with_text:
        return p
    return p.join(docs.select("doc_id", "text"), "doc_id").select(
        "post_id", "ts", "symbol", "text", "doc_id")


def values_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A literal table. Spark knows its size, so small ones are broadcast without a hint."""
    def literal(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else str(v)

    names = ", ".join(schema.names)
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def lexicon(spark: SparkSession, entries=None) -> DataFrame:
    """A lexicon table ``(token, valence)``; defaults to the demo entries."""
    return values_table(spark, list(entries or DEMO_LEXICON), schemas.LEXICON)


def lemmas(spark: SparkSession, entries=None) -> DataFrame:
    """A lemma table ``(form, lemma)``; defaults to the demo entries."""
    return values_table(spark, list(entries or DEMO_LEMMAS), schemas.LEMMAS)


def sql_values(rows) -> str:
    """Rows as a SQL VALUES list (for the oracle queries)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


PRICES_SQL = """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
       min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
       max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) AS volume
FROM orders GROUP BY 1, 2
"""

POSTS_SQL = """
SELECT p.post_id, p.ts, p.symbol, d.text, d.doc_id
FROM (SELECT o_orderkey AS post_id, o_orderdate AS ts, o_orderpriority AS symbol,
             o_orderkey % (SELECT count(*) FROM documents) AS doc_id
      FROM orders) p
JOIN documents d ON p.doc_id = d.doc_id
"""
