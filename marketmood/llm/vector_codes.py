"""Vector code compression: product codebooks trained and applied in exact integer arithmetic.

Entries become integers floor(256 * x); vectors are cut into equal parts and
each part is coded by the nearest entry of its codebook. Dot products run as
float64 BLAS products of limbs: integers are broken into limbs so narrow that
no sum of limb products reaches 2^53, so every product is exact, and the limb
products are shifted and added in int64. Ties go to the first entry.

A training round is one pass: each task returns sums and counts of its parts by
entry (at most parts * entries * width longs), Spark adds them, and only the
codebooks, whose size is parts * entries * width, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import broadcast_if_small, read_table, stored
from marketmood.llm.vectors import dimension, finite, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def limbs(values: np.ndarray, count: int, bits: int) -> list[np.ndarray]:
    """``values`` = sum of limb i * 2^(bits * i); the last limb carries the sign."""
    low = [(values >> bits * i) & ((1 << bits) - 1) for i in range(count - 1)]
    return [x.astype(np.float64) for x in [*low, values >> bits * (count - 1)]]


def exact_product(a: np.ndarray, b: np.ndarray, least_limbs: int = 2) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact; raises OverflowError where int64 can't be sure to hold it.

    Limbs have at most (53 - log2(inner size)) / 2 bits, so a float64 product of
    limbs stays below 2^53; narrower ones are taken to have ``least_limbs``.
    """
    inner = a.shape[1]
    most = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (a, b)]
    if inner * most[0] * most[1] >= 1 << 63:
        raise OverflowError("dot products don't fit in 64 bits")
    widest = (53 - max(1, inner).bit_length()) // 2
    cut = []
    for x, m in ((a, most[0]), (b, most[1])):
        bits = m.bit_length() + 1
        count = max(least_limbs, -(-bits // widest))
        cut.append((limbs(x, count, width := -(-bits // count)), width))
    (left, wa), (right, wb) = cut
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (wa * i + wb * j)
    return out


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as int64; raises OverflowError beyond 2^28, where distances leave 64 bits."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= 1 << 28:
        raise OverflowError("vector entries of 2^20 and more can't be coded in 64 bits")
    return out.astype(np.int64)


def nearest_entries(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (first of equals) and its squared distance; both (rows, parts).

    ``rows`` are integer vectors, ``books`` has shape (parts, entries, width).
    """
    n, parts, width = len(rows), books.shape[0], books.shape[2]
    index, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    for p in range(parts):
        x = rows[:, p * width:(p + 1) * width]
        score = (books[p] * books[p]).sum(axis=1) - 2 * exact_product(x, books[p].T)
        index[:, p] = first = score.argmin(axis=1)
        error[:, p] = (x * x).sum(axis=1) + score[np.arange(n), first]
    return index, error


def first_books(vectors: DataFrame, vec_id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks of the rows with the smallest ids (null ids last, equal ids by vector); None without rows."""
    rows = vectors.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).select(vector).limit(entries).collect()
    if not rows:
        return None
    if len({len(r[0]) for r in rows}) > 1 or len(rows[0][0]) % parts:
        raise ValueError(f"vectors need one length that is a multiple of {parts}")
    start = integers(np.array([r[0] for r in rows], np.float64))
    return start.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def train_round(vectors: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            rows = integers(matrix(batch.column(0), parts * width))
            index, _ = nearest_entries(rows, books)
            for p in range(parts):
                total[p, :, width] += np.bincount(index[:, p], minlength=entries)
                for k in range(width):  # a batch's sums are far below 2^53
                    total[p, :, k] += np.bincount(index[:, p], rows[:, p * width + k], entries).astype(np.int64)
        used = np.repeat(total[:, :, width].ravel() > 0, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(total.ravel()[used])], names=["at", "v"])

    found = (vectors.select(vector).mapInArrow(sums, "at long, v long")
             .groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    total = {r["at"]: int(r["v"]) for r in found}
    new = books.copy()
    for slot in range(parts * entries):
        if count := total.get(slot * (width + 1) + width, 0):
            new[divmod(slot, entries)] = [total[slot * (width + 1) + k] // count for k in range(width)]
    return new


def train_books(vectors: DataFrame, vec_id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES,
                rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over all rows; fewer rows than entries give fewer entries."""
    books = first_books(vectors, vec_id, vector, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = train_round(vectors, vector, books)
    return books


def encode(vectors: DataFrame, vector: str, books: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``code`` (two hex digits a part) and ``error`` (sum of the parts' squared distances)."""
    parts, _, width = books.shape

    def coded(batches):
        for batch in batches:
            index, error = nearest_entries(integers(matrix(batch.column(batch.num_columns - 1), parts * width)), books)
            digits = index.astype(np.uint8).tobytes().hex()
            codes = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(error.sum(axis=1))],
                                             names=[*keep, "code", "error"])

    kept = vectors.select(*keep)
    schema = kept.schema.add("code", "string").add("error", "long")
    return vectors.select(*keep, vector).mapInArrow(coded, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p][i] for p, i in enumerate(bytes.fromhex(code))])


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every row whose vector is whole.

    Rows whose vector is null, empty or holds null or non-finite entries are
    dropped; vectors of different lengths, or a length that isn't a multiple of
    16, raise an error. Repeated rows and repeated or null ids are coded each;
    of rows with one id the smaller vector comes first in the starting
    codebook, null ids come last. ``label_error`` sums over equal labels, nulls
    together. No rows give an empty result. Other columns are ignored.
    """
    rows = df.filter(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                                                   F.col(vector).alias("vector"))
    books = train_books(rows, "vec_id", "vector")
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(rows, "vector", books, ["vec_id", "label"]), "vector-codes")
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long")
                                                                .alias("label_error")), "label-errors")
    return (coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")))


def op12_vector_codes(spark, sf_dir) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def _assigned(k: int) -> str:
    """SQL of a round's assignment: of each part the nearest entry, ties to the smaller."""
    return f"""d{k} AS (SELECT vec_id, s.part, entry, sum((s.v - b.c) * (s.v - b.c)) AS d
      FROM vals s JOIN books{k} b ON s.part = b.part AND s.pos = b.pos GROUP BY vec_id, s.part, entry),
    near{k} AS (SELECT vec_id, part, (min(d * 64 + entry) % 64)::BIGINT AS entry, min(d)::BIGINT AS d FROM d{k} GROUP BY vec_id, part)"""


def _moved(k: int) -> str:
    """SQL of the codebooks after round k."""
    return f"""books{k + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN
      (SELECT n.part, n.entry, s.pos, floor(sum(s.v)::DOUBLE / count(*))::BIGINT AS c
       FROM near{k} n JOIN vals s ON s.vec_id = n.vec_id AND s.part = n.part GROUP BY n.part, n.entry, s.pos) m
      ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // 16 AS width FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  slots AS (SELECT vec_id, embedding, width, unnest(range(len(embedding))) AS i FROM kept),
  vals AS (SELECT vec_id, i // width AS part, i % width AS pos, floor(256 * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM slots),
  firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
  books0 AS (SELECT part, entry, pos, v AS c FROM firsts JOIN vals USING (vec_id)),
  {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
  coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
