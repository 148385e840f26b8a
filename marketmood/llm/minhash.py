"""Document fingerprints: MinHash over word shingles, banded joins, verified Jaccard.

Words are runs of bytes other than ASCII white space after A-Z is lower-cased;
a shingle is five words (all words of a shorter text). Shingles are hashed from
word hashes in vectorised numpy, and ``PERMUTATIONS`` multiply-add functions
over them give the minima. A fingerprint writes 16 mixed bits of each minimum
in hex; the share of equal ones estimates the Jaccard similarity. Texts without
words (null, empty, blank) share the fingerprint of all ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import pieces, read_table, rows_of, stored, utf8
from marketmood.llm.components import connected_components

WIDTH = 5
PERMUTATIONS = 128
BANDS = 32
SEED = 20
_U = np.uint64


def _odd(rng, n) -> np.ndarray:
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply, shift, exclusive-or)."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hasher:
    """Shingle hashes and minima; holds the powers that word hashes need (grown on demand)."""

    def __init__(self, width: int = WIDTH, permutations: int = PERMUTATIONS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.width = width
        self.base = int(_odd(rng, 1)[0]) | 1
        self.place = _odd(rng, width)
        self.mul, self.add = _odd(rng, permutations)[:, None], rng.integers(0, 1 << 63, permutations, dtype=np.uint64)[:, None]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            inv = pow(self.base, -1, 1 << 64)
            self.powers = np.cumprod(np.r_[_U(1), np.full(n - 1, self.base, np.uint64)])
            self.inverse = np.cumprod(np.r_[_U(1), np.full(n - 1, inv, np.uint64)])

    def word_hashes(self, data: bytes) -> np.ndarray:
        """A polynomial hash of each word, wherever it stands: prefix sums divided by the start's power."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64)
        self._grow(len(b))
        inside = np.r_[False, ~self.space[b], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.r_[_U(0), np.cumsum((b.astype(np.uint64) + _U(1)) * self.powers[:len(b)])]
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, text: str | None):
        """Hashes of all shingles, block by block."""
        tail, total = np.zeros(0, np.uint64), 0
        for block in pieces(utf8(text).lower()):
            found = self.word_hashes(block)
            total += len(found)
            words = np.r_[tail, found]
            n = len(words) - self.width + 1
            if n > 0:
                out = words[:n] * self.place[0]
                for k in range(1, self.width):
                    out += words[k:k + n] * self.place[k]
                yield mixed(out)
                words = words[n:]
            tail = words
        if 0 < total < self.width:
            yield mixed((tail * self.place[:len(tail)]).sum(dtype=np.uint64, keepdims=True))

    def signature(self, text: str | None) -> np.ndarray:
        """Minimum of each permutation over the shingles."""
        least = np.full(len(self.mul), np.iinfo(np.uint64).max)
        for found in self.shingles(text):
            for i in range(0, len(found), 256):
                least = np.minimum(least, (found[None, i:i + 256] * self.mul + self.add).min(axis=1))
        return least


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; all ones for a signature without shingles."""
    empty = signature == np.iinfo(np.uint64).max
    return np.where(empty, 0xFFFF, mixed(signature) >> _U(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text whose last floor(n / 2) characters are replaced by the first as many of the following text."""
    m = len(text) // 2
    return text[:len(text) - m] + following[:m]


def with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Rows ``(bucket, later, id, t)`` laid out so that each row is followed, in its partition, by the next one.

    The order is by descending id, null ids last, rows of one id by their
    text's hash and text; after the last row comes the first. Id ranges become
    buckets; the first row of each is also sent, marked ``later``, behind the
    rows of the bucket before. So texts are shuffled once, and the driver sees
    one id and hash for each bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("double"), shares, 8 * n)).first()[0] or []
    at = -np.unique(np.array(cuts, np.float64))[::-1]  # ascending in the order of descending ids

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(at, -ids.to_numpy(np.float64, na_value=np.nan), side="right")
        return pd.Series(np.where(ids.isna(), len(at) + 1, own).astype(np.int32))

    keyed = rows.withColumn("bucket", bucket_of("id")).withColumn("h", F.xxhash64("t"))
    first = keyed.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("h").alias("nh"))).alias("f")).orderBy("bucket").collect()
    table = spark.createDataFrame(
        [(r["bucket"], r["f"]["id"], ~r["f"]["nh"], first[i - 1]["bucket"]) for i, r in enumerate(first)],
        "bucket int, first_id long, first_h long, before int")
    starts = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct("bucket", F.lit(False).alias("later"))
    dealt = (keyed.join(F.broadcast(table), "bucket")  # one row a bucket
             .select("id", "t", "h", F.inline(F.when(starts, F.array(own, F.struct(F.col("before").alias("bucket"),
                                                                                 F.lit(True).alias("later"))))
                                              .otherwise(F.array(own)))))
    return (dealt.repartition("bucket")
            .sortWithinPartitions("bucket", "later", F.desc_nulls_last("id"), "h", "t").select("bucket", "later", "id", "t"))


def edit_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Null texts count as empty. Every row gives a row; an empty table gives none.
    """
    def work(batches):
        hasher, names = Hasher(), ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            rows = []
            for bucket, later, key, t in rows_of(batch):
                if held is not None and held[0] != bucket:
                    held = None
                if held is None and later:
                    continue  # a repeat of the first row behind the one that was used
                own = short(hasher.signature(t))
                if held is not None:
                    _, k, u, sig = held
                    made = edited(u, t)
                    other = sig if made == u else short(hasher.signature(made))
                    rows.append((k, len(u), hashlib.sha256(made.encode()).hexdigest(), sig.tobytes().hex(),
                                 other.tobytes().hex(), likeness(sig, other), likeness(sig, own)))
                held = None if later else (bucket, key, t, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)

    found = with_next(docs, text, id_col, buckets).mapInArrow(
        work, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)


def similar_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8,
                  bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): verified links between different texts, and which rows have which text.

    Equal texts share a class, named by 64 bits of their words, so copies are
    joined once. Classes whose signatures agree in one of ``bands`` bands are
    candidates (at 0.8 a pair is missed with a chance below 1e-7); the exact
    Jaccard similarity of their shingle sets decides. ``pairs`` has (a, b,
    jaccard) of class ids, a < b; ``members`` has (row_id, class_id).
    """
    def sets(batches):
        hasher = Hasher()
        for batch in batches:
            ids, found, values = [], [], []
            for key, t in rows_of(batch):
                parts = list(hasher.shingles(t))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                ids.append(key)
                values.append(own.view(np.int64))
                least = hasher.signature(t).reshape(bands, -1) if parts else np.zeros((0, 1), np.uint64)
                found.append([int.from_bytes(hashlib.blake2b(bytes([i]) + row.tobytes(), digest_size=7).digest(), "big")
                              for i, row in enumerate(least)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64())),
                                              pa.array(values, pa.list_(pa.int64()))], names=["class_id", "bands", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("class_id", F.xxhash64("t"))
    texts = rows.groupBy("class_id").agg(F.first("t").alias("t"))
    base = stored(texts.mapInArrow(sets, "class_id long, bands array<long>, shingles array<long>"), "minhash-sets")
    keys = base.select("class_id", F.explode("bands").alias("band"))
    met = (keys.withColumnRenamed("class_id", "a").join(keys.withColumnRenamed("class_id", "b"), "band")
           .filter("a < b").select("a", "b").distinct())
    side = lambda k: base.select(F.col("class_id").alias(k), F.col("shingles").alias(f"{k}_set"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    pairs = (both.withColumn("jaccard", common / (F.size("a_set") + F.size("b_set") - common))
             .filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard"))
    return pairs, rows.select("row_id", "class_id")


def near_duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``(row_id, group_id, links)``: smallest id of the row's component and its class's number of links."""
    pairs, members = similar_pairs(docs, text, id_col, threshold)
    pairs = stored(pairs, "minhash-pairs")
    roots = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    named = (stored(members, "minhash-members").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
             .withColumn("root", F.coalesce("root", "class_id")).join(links, "class_id", "left"))
    least = named.groupBy("root").agg(F.min("row_id").alias("group_id"))
    return named.join(least, "root").select("row_id", "group_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def op5_minhash(spark, sf_dir) -> DataFrame:
    return edit_fingerprints(read_table(spark, sf_dir, "documents"))
