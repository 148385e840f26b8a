"""Vector columns: which rows take part, and Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 1.7976931348623157e308


def finite(vector: Column) -> Column:
    """True for vectors with at least one entry whose entries are all finite numbers; never null."""
    entries = F.forall(vector, lambda x: x.isNotNull() & x.cast("double").between(-MOST, MOST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & entries, F.lit(False))


def entry_type(df: DataFrame, vector: str) -> str:
    """``float`` or ``double``: what the vectors are carried as (other number types become double)."""
    kind = df.schema[vector].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def dimension(vectors: DataFrame, vector: str) -> int | None:
    """Length of one vector, None without rows. Tasks compare it with their own (``matrix``)."""
    row = vectors.select(F.size(vector).alias("d")).first()
    return None if row is None else row["d"]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls; raises if one has another length than ``dim``."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if (np.diff(at) != dim).any():
        raise ValueError(f"vectors of different lengths: {dim} and {np.diff(at)[np.diff(at) != dim][0]}")
    return flat.reshape(len(column), dim)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()),
                                    pa.array(values.ravel(), kind))
