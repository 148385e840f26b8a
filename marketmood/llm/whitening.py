"""Embedding whitening by FEAST contour integration of an exactly summed covariance.

Spark sums the covariance: entries become integers floor(64 c) + 1,000,000, the
distinct vectors (the fit list) are written once, one pass gives n and the sums
S, a second the products of the vectors less the rounded mean. All of that is
integer arithmetic, so n * G - T T' over n^2 is the exact centred covariance,
rounded once, whatever the order of the tasks. Only sums by dimension reach the
driver (d * d numbers for d dimensions).

The eigenpairs come from FEAST: the inertia of shifted covariances (Sylvester's
law, by a pivoted symmetric factorisation) counts the eigenvalues above a shift
and cuts the upper spectrum into intervals; for each interval a Gauss-Legendre
quadrature of complex shifted solves on a circle projects a block of vectors
onto the interval's eigenspace, a Rayleigh-Ritz step extracts the eigenpairs,
and the step is repeated until as many have converged as the inertia counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import read_table, stored
from marketmood.llm.vector_codes import exact_product
from marketmood.llm.vectors import dimension, finite, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
NODES = 8
FULL = 1 << 62


# ---- eigenpairs by contour integration ----

def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, by L D L' with 1x1 and 2x2 pivots (Bunch and Kaufman)."""
    a, n, k, positive = a.copy(), len(a), 0, 0
    alpha = (1 + 17 ** 0.5) / 8
    while k < n:
        step, swap = 1, k
        if k < n - 1:
            below = np.abs(a[k + 1:, k])
            r = k + 1 + int(below.argmax())
            most, own = below[r - k - 1], abs(a[k, k])
            if own < alpha * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if own * widest < alpha * most * most:
                    if abs(a[r, r]) >= alpha * widest:
                        swap = r
                    else:
                        step, swap = 2, r
        to = k + step - 1
        if swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        if step == 1:
            if a[k, k] != 0:
                positive += a[k, k] > 0
                w = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(w, w / a[k, k])
        else:
            positive += 1  # such a 2x2 pivot has one positive and one negative eigenvalue
            w = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= w @ np.linalg.solve(a[k:k + 2, k:k + 2], w.T)
        k += step
    return int(positive)


def count_above(v: np.ndarray, shift: float) -> int:
    return positive_pivots(v - shift * np.eye(len(v)))


def clear_shift(v: np.ndarray, shift: float, margin: float) -> tuple[float, int]:
    """``shift``, moved up a little if an eigenvalue lies within ``margin`` of it, and the count above."""
    for _ in range(4 * len(v)):
        above = count_above(v, shift + margin)
        if above == count_above(v, shift - margin):
            return shift, above
        shift += 4 * margin
    raise ArithmeticError("no shift between the eigenvalues")


def project(v: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quadrature of the resolvent on the circle over (low, high): the block's part in that eigenspace.

    The matrix is real, so the lower half circle adds the complex conjugate.
    """
    x, weights = np.polynomial.legendre.leggauss(NODES)
    radius, out = (high - low) / 2, np.zeros_like(block)
    for angle, weight in zip(np.pi / 2 * (1 + x), weights):
        arm = radius * np.exp(1j * angle)
        shifted = ((low + high) / 2 + arm) * np.eye(len(v)) - v
        out += weight / 2 * (arm * np.linalg.solve(shifted, block)).real
    return out


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values (rising) and vectors of the space that the block spans."""
    q = np.linalg.qr(block)[0]
    small = q.T @ v @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turn


def interval_pairs(v: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high); raises if the iteration can't find that many."""
    d, size = len(v), min(len(v), max(count + 4, count * 3 // 2))
    good = 8 * d * np.finfo(float).eps * scale
    rng = np.random.default_rng(d)
    while True:
        block = rng.standard_normal((d, size))
        for _ in range(30):
            values, block = ritz(v, project(v, block, low, high))
            inside = (values > low) & (values < high)
            miss = np.linalg.norm(v @ block - block * values, axis=0)
            if inside.sum() == count and (miss[inside] <= good).all():
                return values[inside], block[:, inside]
        if size == d:
            raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}) by inertia, others by the contour")
        size = min(d, 2 * size)


def top_pairs(v: np.ndarray, want: int, group: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues above rounding (fewer if there are fewer), falling, and unit eigenvectors as columns.

    Equal eigenvalues give some orthonormal basis, the same for the same matrix;
    a vector's largest entry is positive.
    """
    scale = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    margin = len(v) * np.finfo(float).eps * scale
    floor, high = 4 * margin, scale * 1.001
    low, above = clear_shift(v, floor, margin)
    want, up = min(want, above), high
    if not want:
        return np.zeros(0), np.zeros((len(v), 0))
    while above > want + group and up - low > 1e-9 * scale:  # raise the lower end to just below the wanted ones
        middle, n = clear_shift(v, (low + up) / 2, margin)
        low, above, up = (middle, n, up) if n >= want else (low, above, middle)
    free, up = low, high
    for _ in range(12):  # and to the middle of the empty stretch above it
        middle = (free + up) / 2
        free, up = (middle, up) if count_above(v, middle) == above else (free, middle)
    low, _ = clear_shift(v, (low + free) / 2, margin)
    todo, found = [(low, high, above, 0)], []
    while todo:
        a, b, over_a, over_b = todo.pop()
        if over_a - over_b > group and b - a > 1e-6 * scale:
            middle, n = clear_shift(v, (a + b) / 2, margin)
            todo += [(a, middle, over_a, n), (middle, b, n, over_b)]
        elif over_a > over_b:
            found.append(interval_pairs(v, a, b, over_a - over_b, scale)[1])
    values, vectors = ritz(v, np.concatenate(found, axis=1))
    if len(values) != above:
        raise ArithmeticError(f"{above} eigenvalues by inertia, {len(values)} found")
    values, vectors = values[::-1][:want], vectors[:, ::-1][:, :want]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(want)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


# ---- sums on the cluster ----

def scaled(vector) -> F.Column:
    """floor(64 c) + 1,000,000 by entry; raises where |64 c| reaches 2^30."""
    def entry(c):
        x = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(x) < 1 << 30, (x + SHIFT).cast("int")).otherwise(
            F.raise_error(F.lit("vector entries of 2^24 and more can't be whitened")).cast("int"))
    return F.transform(vector, entry)


def _sums(df: DataFrame, by: list[str]) -> list:
    kind = "decimal(38,0)" if dict(df.dtypes)["v"] == "bigint" else "double"
    return df.groupBy(*by).agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()


def column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    def sums(batches):
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total[:dim] += x.sum(axis=0, dtype=np.int64)
            total[dim] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(total)], names=["i", "v"])

    found = {r["i"]: int(r["v"]) for r in _sums(fit.mapInArrow(sums, "i long, v long"), ["i"])}
    return found[dim], [found[i] for i in range(dim)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, int, float]:
    """The centred covariance (divisor n), the largest distance from the rounded mean, and the exact trace as double."""
    dim = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def products(batches):
        def row(total, most):
            at = np.triu_indices(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(at[0], -1)), pa.array(np.append(at[1], -1)), pa.array(np.append(total[at], most))],
                names=["i", "j", "v"])

        total, bound, most = np.zeros((dim, dim), np.int64), 0, 0
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.int64) - middle
            widest = int(np.abs(x).max(initial=0))
            most = max(most, widest)
            step = max(1, min(len(x), FULL // max(1, widest * widest)))
            for i in range(0, len(x), step):
                part = x[i:i + step]
                if bound + len(part) * widest * widest >= FULL:  # what 64 bits hold goes out
                    yield row(total, 0)
                    total, bound = np.zeros((dim, dim), np.int64), 0
                total += exact_product(part.T.copy(), part, 1)
                bound += len(part) * widest * widest
        yield row(total, most)

    both = (fit.mapInArrow(products, "i long, j long, v long").groupBy("i", "j")
            .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.max("v").alias("most")).collect())
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    v, trace, most = np.zeros((dim, dim)), 0, 0
    for r in both:
        i, j = r["i"], r["j"]
        if i < 0:
            most = int(r["most"])
            continue
        exact = n * int(r["v"]) - rest[i] * rest[j]
        trace += exact * (i == j)
        v[i, j] = v[j, i] = exact / (n * n)
    return v, most, trace / (n * n)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are
    dropped; repeated rows and null or repeated ids give rows each, but equal
    vectors count once in the covariance. Components whose eigenvalue is zero to
    rounding can't be whitened and are left out, so a table of equal vectors (or
    none) gives an empty result. Vectors of different lengths, entries of 2^24
    and more and deviations beyond 64 bits raise an error. Other columns are
    ignored.
    """
    rows = df.filter(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), scaled(F.col(vector)).alias("x"))
    schema = (rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long")
              .add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    dim = dimension(fit, "x")
    if dim is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums = column_sums(fit, dim)
    v, most, trace = covariance(fit, n, sums)
    values, vectors = top_pairs(v, min(components, dim))
    k = len(values)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    offset, turn = np.array([r / n for r in rest]), vectors / np.sqrt(values)
    explained = values / trace

    def moved(column):
        x = matrix(column, dim).astype(np.int64) - middle
        return x, (x - offset) @ turn

    def squares(batches):
        total = np.zeros((k, k))
        for batch in batches:
            _, y = moved(batch.column(0))
            total += y.T @ y
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    found = _sums(fit.mapInArrow(squares, "i long, j long, v double"), ["i", "j"])
    identity_error = max(abs(r["v"] / n - (r["i"] == r["j"])) for r in found)
    small = dim * (n * (most + 1)) ** 2 < FULL
    own = np.array(rest, np.int64 if small else object)

    def deviations(x):
        away = (x if small else x.astype(object)) * n - own
        out = (away * away).sum(axis=1)
        if not small and out.max() >= 1 << 63:
            raise OverflowError("deviations don't fit in 64 bits")
        return out.astype(np.int64)

    def rows_out(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = moved(part.column(1))
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviations(x), k)), pa.array(y.ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, identity_error))], names=schema.names)

    return rows.mapInArrow(rows_out, schema)


def op11_whitening(spark, sf_dir) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
