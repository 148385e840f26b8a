"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.
It turns a vector, and the signed axis that lies nearest (the entry of largest
size, with its sign) is its hash; the hashes of ``polytopes`` rotations make the
bucket of one table. A query looks into the buckets of the axes that lie nearest
to it, best first (multiprobe), in every table; what it meets there is ranked
by the exact distance on the original vectors.

Sizes follow the data. ``polytopes`` grows with the logarithm of the rows, so a
bucket keeps about ``bucket_rows`` rows. The number of probes is fitted: for a
bounded sample of queries the true neighbours are found by comparison with all
rows, and the least number is taken whose buckets hold ``target`` of them. A query
that meets fewer rows than it needs probes further until it has enough.

Every row is indexed once a table and carried with its vector, so rows meet
queries in one shuffle a table. Buckets are cut into tiles of about ``tile_rows``
rows, and the queries of a bucket into parts, both by hash; a task holds one tile
and streams its queries, and returns no more than k rows a query and tile. All
sorting is Spark's and can spill.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.llm.common import broadcast_if_small, read_table, stored
from marketmood.llm.vectors import dimension, entry_type, finite, lists, matrix


@dataclass(frozen=True)
class Settings:
    tables: int = 2
    bucket_rows: int = 256      # rows that an average bucket has at least
    target: float = 0.96        # share of true neighbours that the sample's probes must meet
    sample_queries: int = 100   # queries that the probes are fitted on
    tile_rows: int = 2048       # rows of a bucket that a task holds at a time
    part_queries: int = 8192    # queries of a bucket that one task compares with a tile
    seed: int = 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


class Index:
    """Rotations of one index: hashes and probe orders of matrices of vectors."""

    def __init__(self, dim: int, tables: int, polytopes: int, seed: int = 42):
        self.dim, self.tables, self.polytopes = dim, tables, polytopes
        self.wide = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, polytopes, 3, self.wide))
        self.axes = 2 * self.wide
        self.buckets = self.axes ** polytopes  # of one table

    def turned(self, x: np.ndarray, table: int, polytope: int) -> np.ndarray:
        """Entries along the signed axes: (rows, axes), the second half negated."""
        y = np.zeros((len(x), self.wide))
        with np.errstate(invalid="ignore", divide="ignore"):
            y[:, :self.dim] = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
        for signs in self.signs[table, polytope]:
            y = hadamard(y * signs)
        return np.concatenate((y, -y), axis=1)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table; tables have buckets of their own."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            code = np.full(len(x), t, np.int64)
            for p in range(self.polytopes):
                code = code * self.axes + self.turned(x, t, p).argmax(axis=1)
            out[:, t] = code
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest buckets of each table, (rows, tables * count).

        A bucket's distance is the sum over its axes of (best entry - entry of
        that axis) squared; the best sums of some rotations extend only best
        sums of fewer, so keeping ``count`` at each step loses none.
        """
        count = min(count, self.buckets)
        blocks = []
        for at in range(0, len(x), step := max(1, (1 << 22) // (count * self.axes))):
            part, tables = x[at:at + step], []
            for t in range(self.tables):
                codes, sums = np.full((len(part), 1), t, np.int64), np.zeros((len(part), 1))
                for p in range(self.polytopes):
                    y = self.turned(part, t, p)
                    away = (y.max(axis=1, keepdims=True) - y) ** 2
                    sums = (sums[:, :, None] + away[:, None, :]).reshape(len(part), -1)
                    codes = (codes[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(part), -1)
                    best = np.argsort(sums, axis=1, kind="stable")[:, :count]
                    sums, codes = np.take_along_axis(sums, best, 1), np.take_along_axis(codes, best, 1)
                tables.append(codes)
            blocks.append(np.concatenate(tables, axis=1))
        return np.concatenate(blocks) if blocks else np.zeros((0, self.tables * count), np.int64)


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, uids: np.ndarray, ids: list, k: int):
    """For each query the k nearest rows but its own: positions of queries, positions of rows, distances.

    A matrix product finds what can be among the k; distances and ties (smaller
    id, null ids last, then row number) are decided on the differences.
    """
    squares = (rows * rows).sum(axis=1)
    rough = squares + (queries * queries).sum(axis=1)[:, None] - 2 * queries @ rows.T
    slack = 1e-12 * (squares.max(initial=0) + (queries * queries).sum(axis=1))
    order = np.argsort(uids)
    at = order[np.minimum(np.searchsorted(uids, own, sorter=order), len(uids) - 1)]
    mine = uids[at] == own
    rough[np.flatnonzero(mine), at[mine]] = np.inf
    limit = np.full(len(queries), np.inf)
    if len(uids) > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
    out = [], [], []
    for i, (row, most) in enumerate(zip(rough, limit)):
        found = np.flatnonzero((row <= most) & (row < np.inf))
        away = rows[found] - queries[i]
        score = np.sqrt((away * away).sum(axis=1))
        ranked = sorted(zip(score.tolist(), [(ids[j] is None, ids[j]) for j in found], uids[found].tolist(), found.tolist()),
                        key=lambda r: (r[0], r[1][0], 0 if r[1][0] else r[1][1], r[2]))[:k]
        out[0].extend([i] * len(ranked))
        out[1].extend(r[3] for r in ranked)
        out[2].extend(r[0] for r in ranked)
    return out


def _with_codes(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])


def best_rows(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k rows of each key with the smallest score, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy(*keys).orderBy("score", F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fitted_probes(coded: DataFrame, queries: DataFrame, index: Index, k: int, s: Settings) -> int:
    """The least number of probes a table that meets ``target`` of the sample's true neighbours (all buckets above 1)."""
    sample = (queries.orderBy(F.xxhash64("vec_id", "vector"), "uid").limit(s.sample_queries)
              .select("uid", "vector").collect())
    own, x = np.array([r["uid"] for r in sample]), np.array([r["vector"] for r in sample], np.float64)
    dim = index.dim

    def compare(batches):
        for batch in batches:
            rows, uids = matrix(batch.column(1), dim).astype(np.float64), batch.column(0).to_numpy()
            codes = matrix(batch.column(2), index.tables)
            for at in range(0, len(rows), 4096):
                part = slice(at, at + 4096)
                i, j, score = nearest(x, own, rows[part], uids[part], uids[part].tolist(), k)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(uids[part][j]), pa.array(uids[part][j]),
                                                  pa.array(score, pa.float64()), lists(codes[part][j], pa.int64())],
                                                 names=["q", "uid", "vec_id", "score", "codes"])

    met = coded.select("uid", "vector", "codes").mapInArrow(
        compare, "q int, uid long, vec_id long, score double, codes array<long>")
    spread = best_rows(met.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(64))), k, ["q", "part"])
    true = [(r["q"], r["codes"]) for r in best_rows(spread.drop("rank"), k, ["q"]).select("q", "codes").collect()]
    count = 1
    while True:
        count = min(count, index.buckets)
        orders = index.probes(x, count).reshape(len(x), index.tables, count)
        met_at = np.full(len(true), count + 1)  # probes that meet each neighbour
        for i, (q, codes) in enumerate(true):
            for t, c in enumerate(codes):
                if (at := np.flatnonzero(orders[q, t] == c)).size:
                    met_at[i] = min(met_at[i], at[0] + 1)
        least = np.sort(met_at)[max(0, int(np.ceil(s.target * len(true))) - 1)] if s.target <= 1 and true else count + 1
        if least <= count:
            return int(least)
        if count == index.buckets:
            return count
        count *= 2


def probed(queries: DataFrame, index: Index, count: int, kind: str) -> DataFrame:
    """A row for each query and bucket that it looks into: ``uid, vec_id, vector, code``."""
    dim = index.dim

    def look(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column(2), dim).astype(np.float64)
                codes = index.probes(x, count)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(codes, pa.int64())],
                                                 names=["uid", "vec_id", "vector", "codes"])

    base = queries.select("uid", "vec_id", "vector")
    return (base.mapInArrow(look, _with_codes(base))
            .select("uid", "vec_id", "vector", F.explode("codes").alias("code")))


def met_rows(coded: DataFrame, queries: DataFrame, index: Index, count: int, k: int, kind: str, s: Settings) -> DataFrame:
    """``quid, query_id, uid, vec_id, score`` of the rows that queries meet, at most k a query and tile."""
    dim, id_type = index.dim, coded.schema["vec_id"].dataType.simpleString()
    looking = probed(queries, index, count, kind)
    held = coded.select("uid", "vec_id", "vector", F.explode("codes").alias("code"))
    sizes = stored(
        held.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))
        .join(looking.groupBy("code").agg(F.count(F.lit(1)).alias("n_queries")), "code")
        .select("code", F.ceil(F.col("n_rows") / s.tile_rows).cast("int").alias("tiles"),
                F.ceil(F.col("n_queries") / s.part_queries).cast("int").alias("parts")), "bucket-sizes")
    sizes = broadcast_if_small(sizes)
    hashed = lambda of: F.pmod(F.xxhash64("uid"), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = held.join(sizes, "code").select("code", hashed("tiles").alias("tile"), all_of("parts").alias("part"),
                                           F.lit(0).alias("side"), "uid", "vec_id", "vector")
    asks = looking.join(sizes, "code").select("code", all_of("tiles").alias("tile"), hashed("parts").alias("part"),
                                              F.lit(1).alias("side"), "uid", "vec_id", "vector")
    dealt = (rows.unionByName(asks).repartition("code", "tile", "part")
             .sortWithinPartitions("code", "tile", "part", "side"))

    def compare(batches):
        key, held_uids, held_ids, held_rows, tile = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                part, now = batch.slice(a, b - a), tuple(keys[a, :3])
                if now != key:
                    key, held_uids, held_ids, held_rows, tile = now, [], [], [], None
                uids, x = part.column(4).to_numpy(), matrix(part.column(6), dim).astype(np.float64)
                if keys[a, 3] == 0:
                    held_uids.append(uids)
                    held_ids += part.column(5).to_pylist()
                    held_rows.append(x)
                    continue
                if tile is None and held_rows:
                    tile = np.concatenate(held_rows), np.concatenate(held_uids)
                if tile is None:
                    continue
                for at in range(0, len(x), 256):
                    i, j, score = nearest(x[at:at + 256], uids[at:at + 256], *tile, held_ids, k)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(uids[at:at + 256][i], pa.int64()), part.column(5).slice(at, 256).take(pa.array(i, pa.int64())),
                        pa.array(tile[1][j], pa.int64()), pa.array([held_ids[n] for n in j], part.column(5).type),
                        pa.array(score, pa.float64())], names=["quid", "query_id", "uid", "vec_id", "score"])

    return dealt.mapInArrow(compare, f"quid long, query_id {id_type}, uid long, vec_id {id_type}, score double")


def search(df: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row for which ``is_query(vec_id column)`` holds.

    Score is the Euclidean distance in double precision; ties go to the smaller
    vec_id, null ids last. Vectors that are null, empty, zero or hold null or
    non-finite entries take no part. Rows are told apart by their place in the
    table, not by id: rows that repeat an id, or all of a row, are candidates
    and queries each, and only the row itself is no candidate of its own; rows
    without an id are candidates. A query gets k rows, or all others if there
    are fewer. Vectors of different lengths raise an error, no rows give an
    empty result; other columns are ignored.
    """
    s = settings
    whole = finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    kind = entry_type(df, vector)
    kept = df.filter(whole).select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).alias("vec_id"),
                                   F.col(vector).cast(f"array<{kind}>").alias("vector"))
    n, dim = kept.count(), dimension(kept, "vector")
    axes = 2 * (1 << max(0, ((dim or 1) - 1).bit_length()))
    polytopes = 1
    while n / axes ** (polytopes + 1) >= s.bucket_rows:
        polytopes += 1
    index = Index(dim or 1, s.tables, polytopes, s.seed)

    def code(batches):
        for batch in batches:
            codes = index.hashes(matrix(batch.column(2), index.dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(codes, pa.int64())],
                                             names=["uid", "vec_id", "vector", "codes"])

    coded = stored(kept.mapInArrow(code, _with_codes(kept)), "polytope-rows")
    queries = coded.filter(is_query(F.col("vec_id")))
    out = coded.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                       F.lit(0.0).alias("score")).limit(0)
    if queries.isEmpty():
        return out
    need, count = min(k, n - 1), fitted_probes(coded, queries, index, k, s)
    while need:
        met = met_rows(coded, queries, index, count, k, kind, s)
        met = met.repartition("quid").dropDuplicates(["quid", "uid"])
        best = stored(best_rows(met, k, ["quid"]), "polytope-found")
        full = best.filter(F.col("rank") == need).select(F.col("quid").alias("uid"))
        out = out.unionByName(best.join(full.withColumnRenamed("uid", "quid"), "quid", "left_semi")
                              .select("query_id", "rank", "vec_id", "score"))
        queries = stored(queries.join(full, "uid", "left_anti"), "polytope-short")
        if count == index.buckets or queries.isEmpty():
            break
        count = min(4 * count, index.buckets)
    return out


def op13_cross_polytope(spark, sf_dir) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
