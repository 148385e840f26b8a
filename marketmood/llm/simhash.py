"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Words are maximal runs of bytes other than ASCII white space, after A-Z is
lower-cased. Each run of ``width`` words (repeats included, joined by single
spaces) is hashed with XXH64, seed 42; a fingerprint bit is set if it is set in
over half of the hashes. Texts with fewer words have one shingle of all their
words; texts without words (null, empty, blank) have fingerprint zero and link
like any other.

Distinct fingerprints are laid out in cells by the population counts of their
two halves. Two fingerprints within ``radius`` bits have counts that differ by
no more than ``radius`` in all, so only tiles of such neighbouring cells are
compared; within a tile pair every value meets every value (numpy exclusive-or
and bit counts), so no link is lost. A tile pair returns a spanning forest of
its links instead of all links, which is what the components need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import free_name, pieces, read_table, small_side, stored, utf8
from marketmood.llm.components import connected_components

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of one text (unsigned)."""
    ones, total, digests, tail = np.zeros(64, np.int64), 0, [], []
    hashed = xxhash.xxh64_digest

    def take(flush: bool):
        nonlocal ones, total, digests
        if digests and (flush or len(digests) >= CHUNK):
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(digests)
            digests = []

    n_words = 0
    for block in pieces(utf8(text).lower()):
        words = block.split()
        n_words += len(words)
        words = tail + words
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:len(words) - width])).tolist()
            digests += [hashed(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]
            take(False)
            words = words[len(words) - width + 1:] if width > 1 else []
        tail = words
    if 0 < n_words < width:
        digests.append(hashed(b" ".join(tail), SEED))
    take(True)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(text, width: int = 4):
    """The fingerprint of a text column, as a signed long column."""

    @F.pandas_udf("long")
    def values(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return values(text)


def _merge(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Spanning forest of the links between two tiles, as positions in a and b."""
    n = len(a)
    label = np.arange(n if same else n + len(b))
    shift = 0 if same else n
    out_a, out_b = [], []
    for i0 in range(0, n, 64):
        near = np.bitwise_count(a[i0:i0 + 64, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(n)[None, :] > np.arange(i0, min(i0 + 64, n))[:, None]
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            i, js = i0 + k, np.flatnonzero(near[k])
            labels = label[js + shift]
            if (labels != label[i]).any():
                roots, first = np.unique(labels, return_index=True)
                other = roots != label[i]
                out_a += [i] * int(other.sum())
                out_b += js[first[other]].tolist()
                merged = np.append(roots, label[i])
                label[np.isin(label, merged)] = merged.min()
    return out_a, out_b


def near_links(values: DataFrame, radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """Links ``(u, v)`` that span the graph of distinct fingerprints at most ``radius`` bits apart.

    ``values`` has one column ``fp`` (long, distinct, stored). Tiles hold about
    ``tile_rows`` values; the comparison is exact and grows with the square of
    the values, less the pairs of cells that the counts rule out.
    """
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    celled = values.select("fp", (high * 64 + low).cast("int").alias("cell"))
    subs = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("subs"))  # at most 33 * 33 rows
    tiles = stored(
        celled.join(F.broadcast(subs), "cell")
        .select("cell", F.pmod(F.xxhash64("fp"), F.col("subs")).alias("sub"), "fp")
        .groupBy("cell", "sub").agg(F.collect_list("fp").alias("fps"))
        .withColumn("tile", F.col("cell") * F.lit(1 << 32) + F.col("sub")), "tiles")
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    near_cells = F.array(*[F.lit(i * 64 + j) for i, j in steps])
    # high and low run from 0 to 32, so cell + step never names another cell by wrapping round
    ids = tiles.select("tile", "cell")
    pairs = (ids.select(F.col("tile").alias("a"), F.explode(F.transform(near_cells, lambda s: s + F.col("cell"))).alias("cell"))
             .join(ids.withColumnRenamed("tile", "b"), "cell").filter("a <= b").select("a", "b"))
    left, right = (tiles.select(F.col("tile").alias(k), F.col("fps").alias(f"{k}_fps")) for k in ("a", "b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_fps", "b_fps")

    def links(batches):
        for batch in batches:
            sides = []
            for k in (2, 3):
                col = batch.column(k)
                flat, at = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
                sides.append([flat[at[i]:at[i + 1]] for i in range(len(col))])
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *sides):
                i, j = _merge(x, y, radius, a == b)
                if i:
                    yield pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)), pa.array(y[j].view(np.int64))],
                                                     names=["u", "v"])

    return met.mapInArrow(links, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4,
                    radius: int = 4, tile_rows: int = 4096) -> DataFrame:
    """``(row_id, text_hash, fp, root, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` bits, the row's own included; rows without an id take part but
    never name a component, so it is null only where no id can be reached.
    ``root`` (a fingerprint) tells such components apart. Repeated rows and
    repeated ids keep one result row each. Other columns are ignored; an empty
    table gives an empty result. ``text_hash`` (64 bits of the text) tells rows
    with the same id apart.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                              fingerprints(docs[text], width).alias("fp")), "simhash")
    least = stored(rows.groupBy("fp").agg(F.min("row_id").alias("first_id")), "simhash-values")
    roots = stored(connected_components(near_links(least.select("fp"), radius, tile_rows)), "simhash-roots")
    rooted = (least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("row_id", "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4,
                         radius: int = 4) -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest id.

    Among rows with that id the one with the smallest text hash stays, null ids
    come last, and equal rows stay once. Null, empty and blank texts form one
    component (fingerprint zero).
    """
    found = stored(near_duplicates(docs, text, id_col, width, radius), "simhash-found")
    first = F.min(F.struct(F.col("row_id").isNull().alias("last"), "row_id", "text_hash"))
    kept = found.groupBy("root").agg(first.alias("k")).select("k.row_id", "k.text_hash")
    keys = found.groupBy("row_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    same = lambda a, b: a["row_id"].eqNullSafe(b["row_id"]) & (a["text_hash"] == b["text_hash"])
    dropped = stored(keys.join(kept, same(keys, kept), "left_anti").select("row_id", "text_hash"), "simhash-dropped")
    again = stored(keys.filter("copies > 1").join(kept, same(keys, kept), "left_semi").select("row_id", "text_hash"),
                   "simhash-again")

    key = free_name(docs, "text_hash")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))

    def of(side):
        return keyed[id_col].eqNullSafe(side["row_id"]) & (keyed[key] == side["text_hash"])

    stay = keyed.join(small_side(dropped), of(dropped), "left_anti")
    if not again.isEmpty():  # repeated rows with one id and text: keep one of each
        once = stay.join(again, of(again), "left_semi").dropDuplicates([id_col, key])
        stay = stay.join(again, of(again), "left_anti").unionByName(once)
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")
