"""Readers and writers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.functions.dates import day_of, parse_date, parse_utc
from marketmood.operators.common import require_unique
from marketmood.sources import schemas


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text-heavy table, split as its files are.

    A table of one file with one row group is read by one task. Whoever runs on
    such files (the benchmark does) sets ``spark.marketmood.textPartitions`` to
    spread the rows by ``key``; it is unset for tables of many files.
    """
    df = read_table(spark, sf_dir, name)
    n = spark.conf.get("spark.marketmood.textPartitions", None)
    return df.repartition(int(n), key) if n else df


CORRUPT = "_corrupt_record"


def _read_csv(spark: SparkSession, path: str, schema, multi_line: bool) -> DataFrame:
    """CSV with a header; lines that don't fit the schema keep their text in ``_corrupt_record``."""
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(with_bad).option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def read_posts(spark: SparkSession, path: str, fmt: str = "csv", scored: bool = False, multi_line: bool = True,
               keep_corrupt: bool = False) -> DataFrame:
    """Posts as ``(ts, text, symbol, company[, cleaned_text, text_length, compound])``.

    CSV is read with an explicit schema. Quoted texts may hold line breaks, so a
    file is read by one task (split a large export into files); with
    ``multi_line=False`` large files are split among tasks, which is only right
    for texts without line breaks. Malformed lines never fail the job: they are left out, or with ``keep_corrupt`` returned with their source
    in ``_corrupt_record``. The ``date`` string (UTC unless it carries an
    offset) is parsed into ``ts``.
    """
    schema = schemas.SCORED_POSTS if scored else schemas.RAW_POSTS
    df = _read_csv(spark, path, schema, multi_line) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    return _without_corrupt(df, keep_corrupt).withColumn("ts", parse_utc("date")).drop("date")


def _without_corrupt(df: DataFrame, keep: bool) -> DataFrame:
    if keep or CORRUPT not in df.columns:
        return df
    # Spark parses only the fields that a query reads; a line is to be judged by all of them.
    fields = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns if c != CORRUPT]))
    return df.filter(F.col(CORRUPT).isNull() & (fields >= 0)).drop(CORRUPT)


def read_prices(spark: SparkSession, path: str, fmt: str = "csv", keep_corrupt: bool = False,
                unique: bool = False) -> DataFrame:
    """Daily prices ``(symbol, date, open, high, low, close, adj_close, volume)``.

    Self-describing formats may hold ``date`` as DATE, TIMESTAMP or text. With
    ``unique``, two rows for one symbol and day are an error (one pass to check).
    """
    if fmt == "csv":
        df = _without_corrupt(_read_csv(spark, path, schemas.PRICES, False), keep_corrupt)
    else:
        df = spark.read.format(fmt).load(path)
        df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in schemas.PRICES.fields if f.name != "date"], "date")
    as_text = isinstance(df.schema["date"].dataType, T.StringType)
    df = df.withColumn("date", parse_date("date") if as_text else day_of(df, "date"))
    return require_unique(df, ["symbol", "date"]) if unique else df


# Partitions that a task may write to at once; rows of further ones are sorted first.
OPEN_FILES = 8


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_posts(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "symbol",
                mode: str = "overwrite", compression: str | None = None) -> None:
    """S3: write scored posts; CSV gets a header, parquet is partitioned by symbol.

    A task writes to the files of all its symbols as the rows come (row groups of
    32 MB, as several are in memory), so posts with their texts aren't sorted by
    symbol. ``compression`` is a codec of the format, e.g. ``gzip`` or ``zstd``;
    a CSV file with quoted line breaks is read by one task either way.
    """
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by).option("parquet.block.size", 32 << 20)
    with _setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        if fmt == "csv":
            (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False).csv(path))
        else:
            w.format(fmt).save(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    """Persist the per-symbol scaler table."""
    scaler.write.mode("overwrite").partitionBy("symbol").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Load a scaler table written by :func:`save_scaler`."""
    return spark.read.schema(schemas.SCALER).parquet(path).select(*schemas.SCALER.names)


def profile_shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_columns)`` computed on the cluster."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))
