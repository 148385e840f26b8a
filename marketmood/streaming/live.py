"""Structured Streaming layer (X1, X2): live daily bars and live daily sentiment.

Two forms. :class:`LiveTable` keeps a table that is right after every
micro-batch: days still open and rows of any lateness are in it, and a stopped
query goes on where it was. ``live_bars`` and ``live_sentiment`` are event-time
windows with a watermark for append-only sinks: state is bounded (a window is
dropped once the watermark passes its end), a row already written never
changes, and rows beyond the watermark are not counted.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.dates import day_of, utc_day
from marketmood.operators.sentiment import score_in_row
from marketmood.session import checkpoint_dir


def table_stream(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """File-source stream over one table of a folder: a single file or a folder of part files."""
    path = f"{folder}/{file_name}"
    table = spark.read.parquet(path)
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1000)
    if len(files) == 1 and files[0].rstrip("/").endswith("/" + file_name):
        return stream.option("pathGlobFilter", file_name).parquet(folder)
    return stream.parquet(path)


def as_utc_instant(c: str):
    """Event time as a zoned TIMESTAMP: NTZ wall-clock values are read as UTC
    (independent of the session zone); zoned timestamps pass through."""
    x = F.col(c)
    return F.make_timestamp(F.year(x), F.month(x), F.dayofmonth(x), F.hour(x), F.minute(x),
                            F.date_part(F.lit("SECOND"), x), F.lit("UTC"))


def _with_event_time(df: DataFrame, ts: str) -> DataFrame:
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return df.withColumn(ts, as_utc_instant(ts))
    return df


def live_bars(stream: DataFrame, ts: str, key: str, price: str, window: str = "1 day",
              watermark: str = "1 hour") -> DataFrame:
    """OHLCV bars per key and tumbling window; of prices at one instant the smallest opens, the largest closes."""
    at = F.struct(ts, price)
    return (_with_event_time(stream, ts).withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(key).alias("symbol"))
            .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, at).alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .select("symbol", utc_day(F.col("w.start")).alias("date"), "open", "high", "low", "close", "volume"))


def live_sentiment(posts: DataFrame, scores: DataFrame, ts: str = "ts", key: str = "symbol",
                   window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Mean compound per symbol and day; posts stream joined to a stored table of scores per document.

    ``scores`` is read again by every micro-batch, so it should be a stored
    table, not a plan that scores the texts.
    """
    joined = posts.join(scores.select("doc_id", "compound"), "doc_id")
    return (_with_event_time(joined, ts).withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(key).alias("symbol"))
            .agg(F.avg("compound").alias("compound"), F.count(F.lit(1)).alias("n_posts"))
            .select("symbol", utc_day(F.col("w.start")).alias("date"), "compound", "n_posts"))


def run_available(spark: SparkSession, query: DataFrame, name: str) -> DataFrame:
    """Process everything available (``availableNow``) into a parquet table in the
    shared checkpoint folder, with its own streaming checkpoint; return the table.

    Append mode writes a window once the watermark has passed its end, and drops
    rows that come later; :class:`LiveTable` has the open windows and late rows too.
    """
    base = os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex}")
    out, chk = os.path.join(base, "out"), os.path.join(base, "chk")
    q = (query.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", chk).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


class LiveTable:
    """A table of daily aggregates that a stream keeps up to date, open and late days included.

    Each micro-batch is reduced to parts (one row for each symbol and day in it:
    minima, maxima, sums and counts) and written to the folder of its batch
    number, which a batch that is run again after a failure overwrites. So a
    batch counts once, whenever the query stops; nothing waits for a watermark
    and no row is too late. Reading merges the parts of all batches; ``compact``
    replaces the parts of finished batches by their merge. The stream's progress
    is kept beside the parts, so a new ``LiveTable`` on the same folder goes on.
    """

    def __init__(self, spark: SparkSession, base: str, parts, merge):
        """``parts(rows)`` aggregates a micro-batch, ``merge(parts)`` adds up parts (its result has their columns)."""
        self.spark, self.base, self.parts, self.merge = spark, base, parts, merge

    def start(self, stream: DataFrame, **trigger):
        """Start (or go on with) the query; by default on what is available now."""
        def write(rows: DataFrame, batch: int) -> None:
            self.parts(rows).write.mode("overwrite").parquet(f"{self.base}/parts/batch={batch}")

        return (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.base}/progress")
                .trigger(**(trigger or {"availableNow": True})).start())

    def run(self, stream: DataFrame) -> "LiveTable":
        self.start(stream).awaitTermination()
        return self

    def _read(self, folder: str, number: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.base}/{folder}").parquet(f"{self.base}/{folder}/{number}=*")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _merged_upto(self) -> int:
        """The last batch that the newest complete merge holds, -1 without one."""
        done = self._read("done", "upto")
        return -1 if done is None else done.agg(F.max("upto")).first()[0]

    def _current(self) -> DataFrame | None:
        upto = self._merged_upto()
        batches = self._read("parts", "batch")
        found = [] if batches is None else [batches.filter(F.col("batch") > upto).drop("batch")]
        if upto >= 0:
            found.append(self.spark.read.parquet(f"{self.base}/merged/upto={upto}"))
        return None if not found else found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def table(self) -> DataFrame | None:
        """The parts of all batches so far, merged; None before the first batch."""
        now = self._current()
        return None if now is None else self.merge(now)

    def compact(self) -> None:
        """Write the merge of all finished batches; a stop in between leaves the older merge in force.

        Call it between runs or from the thread that runs the query: a batch that
        is being written is not finished.
        """
        batches = self._read("parts", "batch")
        last = None if batches is None else batches.agg(F.max("batch")).first()[0]
        if last is None or last <= self._merged_upto():
            return
        self.merge(self._current()).write.mode("overwrite").parquet(f"{self.base}/merged/upto={last}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.base}/done/upto={last}")


def bar_parts(ts: str, key: str, price: str):
    """Parts of daily OHLCV bars; of prices at one instant the smallest opens, the largest closes."""
    def parts(rows: DataFrame) -> DataFrame:
        at = F.struct(F.col(ts).alias("at"), F.col(price).alias("price"))
        return rows.groupBy(F.col(key).alias("symbol"), day_of(rows, ts).alias("date")).agg(
            F.min(at).alias("first"), F.max(at).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.count(F.lit(1)).alias("volume"))
    return parts


def merge_bar_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "date").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"))


def bars_of(table: DataFrame) -> DataFrame:
    """``(symbol, date, open, high, low, close, volume)`` of merged bar parts."""
    return table.select("symbol", "date", F.col("first.price").alias("open"), "high", "low",
                        F.col("last.price").alias("close"), "volume")


def sentiment_parts(lex, ts: str = "ts", key: str = "symbol", text: str = "text", texts: DataFrame | None = None,
                    by: str = "doc_id", **rules):
    """Parts of daily mean sentiment; every post's text is scored in its own micro-batch.

    Posts that name a text by id come with the table ``texts(by, text)``: posts of
    a micro-batch are counted by symbol, day and id, and each text they name is
    scored there once, however many name it.
    """
    def parts(rows: DataFrame) -> DataFrame:
        scored = score_in_row(rows, text, lex, **rules)
        return scored.groupBy(F.col(key).alias("symbol"), day_of(scored, ts).alias("date")).agg(
            F.sum("compound").alias("total"), F.count("compound").alias("n_scored"), F.count(F.lit(1)).alias("n_posts"))

    def parts_by_id(rows: DataFrame) -> DataFrame:
        named = rows.groupBy(F.col(key).alias("symbol"), day_of(rows, ts).alias("date"), by).agg(F.count(F.lit(1)).alias("n"))
        found = texts.select(by, text).join(named.select(by).distinct(), by, "left_semi")
        scored = named.join(score_in_row(found, text, lex, **rules).select(by, "compound"), by)
        return scored.groupBy("symbol", "date").agg(
            F.sum(F.col("compound") * F.col("n")).alias("total"),
            F.coalesce(F.sum(F.when(F.col("compound").isNotNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("n_scored"),
            F.sum("n").alias("n_posts"))

    return parts if texts is None else parts_by_id


def merge_sentiment_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "date").agg(F.sum("total").alias("total"), F.sum("n_scored").alias("n_scored"),
                                               F.sum("n_posts").alias("n_posts"))


def sentiment_of(table: DataFrame) -> DataFrame:
    """``(symbol, date, compound, n_posts)`` of merged sentiment parts; NULL where no text could be scored."""
    return table.select("symbol", "date", F.try_divide("total", F.col("n_scored").cast("double")).alias("compound"), "n_posts")
