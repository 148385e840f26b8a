"""Content-addressed WARC archive.

An archive is two Parquet tables in a shared folder. ``payloads`` holds the
bytes of every distinct payload once, under its SHA-256; a second digest and
the length, taken of every row, must agree within a digest, or writing fails.
``headers`` holds each record's exact header bytes with the digest of its
payload. Reading joins the two, checks the stored bytes against their digest,
and gives back the original records: header bytes, block and the two closing
line ends.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the
largest id is a response and the others are revisits of it, whose block is
empty; smaller payloads always get a response.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.llm.common import read_table
from marketmood.session import checkpoint_dir

MIN_REVISIT = 1000
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/headers")


def record_id(id_col: Column) -> Column:
    """A stable URN from the record's id (name-based, SHA-1)."""
    h = F.sha1(F.concat(F.lit("record:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"),
                    part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def header_text() -> Column:
    """Header lines of a record and the blank line that ends them; columns as in ``write``."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", _one_line(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("keeper"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(END))


def digest(payload: Column) -> Column:
    """The digest that payloads are stored under."""
    return F.sha2(payload, 256)


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload: str = "html", url: str = "url",
          min_revisit: int = MIN_REVISIT) -> Archive:
    """Write a record for every row of ``pages`` into a new archive at ``path`` (a shared folder).

    A null payload is empty, a null URL an empty header. Rows that share the
    largest id of their payload are all responses, so repeated rows are kept as
    they are; null ids count as smaller than any. Other columns are not stored.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.select("page_id", "url", "payload", digest(F.col("payload")).alias("sha256"),
                       F.octet_length("payload").cast("long").alias("bytes"))
    kept = rows.select("sha256", "payload", "bytes", F.xxhash64("payload").alias("check"))
    clash = (F.min("check") != F.max("check")) | (F.min("bytes") != F.max("bytes"))
    # the check is a part of a stored column, as a column that is dropped would never be computed
    size = F.when(clash, F.raise_error(F.lit("two payloads with one digest")).cast("long")).otherwise(F.max("bytes"))
    (kept.groupBy("sha256").agg(F.first("payload").alias("payload"), size.alias("bytes")).withColumn("sha1", F.sha1("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    light = rows.select("page_id", "url", "sha256", "bytes")
    groups = (spark.read.parquet(f"{path}/payloads").select("sha256", "sha1")
              .join(light.groupBy("sha256").agg(F.max("page_id").alias("keeper")), "sha256"))
    big = (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    (light.join(groups, "sha256")
     .withColumn("record_type", F.when(big, "revisit").otherwise("response"))
     .select("page_id", "sha256", header_text().cast("binary").alias("header"),
             F.when(big, F.col("keeper")).alias("refers_to"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))
    return Archive(path)


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """``(page_id, header, payload, record, refers_to)``: every record rebuilt by joining headers and payloads.

    ``payload`` is the full payload, also of revisits; ``record`` the original
    bytes. Fails if stored bytes don't match their digest.
    """
    store = archive.payloads(spark)
    checked = store.withColumn("payload", F.when(digest(F.col("payload")) == F.col("sha256"), F.col("payload"))
                               .otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("binary")))
    joined = archive.headers(spark).join(checked, "sha256")
    block = F.when(F.col("header").cast("string").contains(f"{END}WARC-Type: revisit{END}"), F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", "header", "payload", "refers_to",
                         F.concat("header", block, F.lit((END + END).encode())).alias("record"))


def field(header: Column, name: str) -> Column:
    """Value of a header line."""
    return F.regexp_extract(header.cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def op4_warc(spark, sf_dir) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read(spark, write(read_table(spark, sf_dir, "pages"), path))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                          F.sha1("payload").alias("payload_digest"), field(F.col("header"), "WARC-Type").alias("record_type"),
                          "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS keeper FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN strlen(p.t) >= {MIN_REVISIT} AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.t) >= {MIN_REVISIT} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN g ON p.t = g.t
"""
