"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.session import checkpoint_dir

# Rows that a side may have to be broadcast; callers count before they hint, and
# use an ordinary shuffle join beyond it. Rows here are a few longs (<= 64 MB).
BROADCAST_ROWS = 1_000_000
# Bytes of values that a broadcast side may have; they are counted first.
BROADCAST_BYTES = 32 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if a stored table has at most ``max_rows`` rows, else the plain table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if a stored table's values take at most ``max_bytes``, else the plain table.

    Counted, not estimated: strings by their bytes, arrays by their entries, other values as 16 bytes.
    """
    def width(kind, value):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.coalesce(F.aggregate(value, F.lit(24).cast("long"),
                                              lambda n, x: n + width(kind.elementType, x).cast("long")), F.lit(24).cast("long"))
            return 16 * F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) + 24
        if isinstance(kind, T.StructType):
            return sum((width(f.dataType, value[f.name]) for f in kind.fields), F.lit(16))
        return F.lit(16)

    size = sum((width(f.dataType, F.col(f"`{f.name}`")).cast("long") for f in df.schema.fields), F.lit(16).cast("long"))
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= max_bytes else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_fraction(key: Column, fraction: float) -> Column:
    """A fixed share of the keys, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, fraction) * 1_000_000)


def pieces(data: bytes, size: int = 1 << 20):
    """Cut UTF-8 bytes at ASCII white space into blocks of about ``size`` bytes.

    Keeps the word lists of a very long text bounded.
    """
    pos, n = 0, len(data)
    while pos < n:
        end = min(pos + size, n)
        if end < n:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        yield data[pos:end]
        pos = end


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def text_pieces(text: str | None, size: int = 1 << 20):
    """Cut a text at white space into blocks of about ``size`` characters (one block for most texts)."""
    text = text or ""
    if len(text) <= size:
        yield text
        return
    pos, space = 0, re.compile(r"\s")
    while pos < len(text):
        found = space.search(text, min(pos + size, len(text)))
        end = found.start() if found else len(text)
        yield text[pos:end]
        pos = end


def rows_of(batch: pa.RecordBatch, size: int = 200):
    """Rows of an Arrow batch as tuples, converted a few at a time to keep memory low."""
    for i in range(0, batch.num_rows, size):
        part = batch.slice(i, size)
        yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)))


def worker_memory() -> dict:
    """A dict of the Python process, kept from one task of a reused worker to the next.

    The package's functions are shipped with each task, so its own module-level
    names are new every time; a module registered with the interpreter stays.
    """
    return vars(sys.modules.setdefault("marketmood_worker_memory", types.ModuleType("marketmood_worker_memory")))
