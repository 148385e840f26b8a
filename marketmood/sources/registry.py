"""Model registry helpers (S6, K4): pick the latest saved model version per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
VERSION_PATTERN = r"_V_(\d+)"
MODEL_PREFIX = "generator"
MODEL_SUFFIX = ".h5"
# --- end of fixed values ----------------------------------------------------


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Listing ``(symbol, path)`` of files under ``root/<symbol>/`` (metadata only)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path"))
    return files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("symbol"), "path")


def latest_model(listing: DataFrame, prefix: str = MODEL_PREFIX, suffix: str = MODEL_SUFFIX) -> DataFrame:
    """Per symbol, the path with the numerically largest ``_V_<n>``.

    Only file names that contain ``prefix`` and end with ``suffix`` count.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = listing.filter(F.contains(name, F.lit(prefix)) & name.endswith(suffix))
    d = d.withColumn("version", F.regexp_extract(name, VERSION_PATTERN, 1))
    d = d.filter(F.col("version") != "").withColumn("version", F.col("version").cast("bigint"))
    return d.groupBy("symbol").agg(F.max_by("path", "version").alias("path"), F.max("version").alias("version"))
