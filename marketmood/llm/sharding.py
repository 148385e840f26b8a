"""Sharding by histogram sort: near-equal bytes in every shard.

Rows are ordered by a 128-bit key, the hash of the text, then of the id, then
the row's number, so equal texts stand together and are parted only where their
group alone exceeds what a shard may be off by; rows that repeat everything are
parted by their number. Rows are written once with their numbers, so all passes
see the same keys. Splitters of that order are found by counting:
each pass counts, in every partition, the exact bytes below a set of candidate
boundaries, sums the histograms, and narrows the interval around each wanted
share to the keys that were seen in it, until a boundary meets the tolerance or
two neighbouring keys remain. Then the rows are exchanged once, into key ranges
finer than the shards, and numbered within them; the ranges' exact counts make
the slots gapless.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.llm.common import free_name, read_table, stored

TOP = 1 << 128
ROW_BITS = 20  # of a key for the row's number: parts of a group of equal rows


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two signed longs a row as 16 bytes that sort like the pair."""
    flip = np.uint64(1 << 63)
    both = np.stack([np.asarray(x, np.int64).view(np.uint64) ^ flip for x in (high, low)], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def as_int(key: bytes) -> int:
    return int.from_bytes(bytes(key).ljust(16, b"\0"), "big")


def histogram(keys: DataFrame, probes: list[int]) -> pd.DataFrame:
    """Exact bytes, rows, least and greatest key in each interval between sorted probes (len(probes) + 1 of them)."""
    at = as_bytes(probes)

    def count(batches):
        total = np.zeros((2, len(at) + 1), np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for b in batches:
            key, size = packed(b["h1"], b["h2"]), b["size"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, size = key[order], size[order]
            cell = np.searchsorted(at, key, side="right")
            cells, first = np.unique(cell, return_index=True)
            total[0, cells] += np.add.reduceat(size, first)
            total[1, cells] += np.diff(np.append(first, len(key)))
            for c, i, j in zip(cells.tolist(), first.tolist(), np.append(first[1:], len(key)).tolist()):
                least[c] = min(least.get(c, key[i]), key[i])
                most[c] = max(most.get(c, key[j - 1]), key[j - 1])
        cells = sorted(least)
        yield pd.DataFrame({"cell": cells, "bytes": total[0, cells], "rows": total[1, cells],
                            "least": [bytes(least[c]).ljust(16, b"\0") for c in cells],
                            "most": [bytes(most[c]).ljust(16, b"\0") for c in cells]})

    sums = (keys.mapInPandas(count, "cell long, bytes long, rows long, least binary, most binary")
            .groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
                                 F.min("least").alias("least"), F.max("most").alias("most")).toPandas())
    return sums.set_index("cell").reindex(range(len(probes) + 1))


def splitters(keys: DataFrame, wanted: list[float], slack: list[float], probes_a_pass: int = 1 << 14) -> list[int]:
    """Keys with about ``wanted[i]`` bytes below them, each off by ``slack[i]`` at most if the rows allow it.

    ``wanted`` ascends. Where one row is larger than the slack, the nearer side of it is taken.
    """
    low, high = [(0, 0)] * len(wanted), [(TOP - 1, None)] * len(wanted)
    done: dict[int, int] = {}
    while len(done) < len(wanted):
        open_ = [i for i in range(len(wanted)) if i not in done]
        each = max(16, probes_a_pass // len(open_))
        probes = set()
        for i in open_:
            a, b = low[i][0], high[i][0]
            probes |= {a + (b - a) * k // each for k in range(each + 1)}
        probes = sorted(probes)
        cells = histogram(keys, probes)
        size = cells["bytes"].fillna(0).to_numpy(np.int64)
        below = np.cumsum(size)[:-1]  # bytes below each probe
        for i in open_:
            k = int(np.searchsorted(below, wanted[i]))  # first probe with at least the wanted bytes below it
            k = min(k, len(probes) - 1)
            ends = [(probes[j], int(below[j])) for j in (k - 1, k) if j >= 0]
            # The wanted share lies in the cell between these probes; a boundary may stand at each of its keys.
            least, most = cells["least"].iloc[k], cells["most"].iloc[k]
            if isinstance(least, (bytes, bytearray)) and k:
                ends += [(as_int(least), int(below[k - 1]))]
                if as_int(most) + 1 < TOP:
                    ends += [(as_int(most) + 1, int(below[k - 1] + size[k]))]
            best = min(ends, key=lambda e: abs(e[1] - wanted[i]))
            inside = as_int(most) - as_int(least) if len(ends) > 2 else 0
            if abs(best[1] - wanted[i]) <= slack[i] or not inside:
                done[i] = best[0]
            else:  # between the least and the greatest key: least + 1 and most are the next bounds
                low[i], high[i] = (as_int(least), 0), (as_int(most), 0)
    out = [done[i] for i in range(len(wanted))]
    return [max(out[:i + 1]) for i in range(len(out))]


def shard(docs: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id", tolerance: float = 0.002,
          range_bytes: int = 256 << 20, least_ranges: int = 8, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``columns`` (default: all) and size, text_crc32, law, shard, slot and grown_shard.

    Size is the text's UTF-8 bytes plus 1 (1 for null and empty texts); shards
    differ from their equal share by ``tolerance`` of it, or by the size of one
    row where rows are larger. Every shard is exchanged as at least
    ``least_ranges`` key ranges of at most about ``range_bytes``, however many
    that makes. Null ids and texts are keys like others. Columns of these names
    in ``docs`` are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    data = docs.drop(*made) if columns is None else docs.select(*columns)
    names = [free_name(data, n) for n in ("h1", "h2", "key_range", "row_no")]
    h1, h2, part, row_no = names
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    low = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(-1 << ROW_BITS)).bitwiseOR(number)
    keyed = stored(docs.select(*[F.col(f"`{c}`") for c in data.columns], F.xxhash64(body).alias(h1), low.alias(h2),
                               (F.octet_length(body) + 1).cast("long").alias("size"),
                               F.crc32(body.cast("binary")).alias("text_crc32")), "shard-rows")
    keys = keyed.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    fine = int(max(least_ranges, -(-total // (shards * range_bytes))))
    n = shards * fine
    at = splitters(keys, [total * i / n for i in range(1, n)],
                   [total / shards * tolerance if i % fine == 0 else total / n / 4 for i in range(1, n)]) if total else []
    bounds = as_bytes(at)
    rows = histogram(keys, at)["rows"].fillna(0).to_numpy(np.int64) if total else np.zeros(1, np.int64)
    start = np.concatenate([np.cumsum(np.append(0, rows[s:s + fine]))[:-1] for s in range(0, len(rows), fine)])
    table = docs.sparkSession.createDataFrame(
        [(i, i // fine, int(start[i])) for i in range(len(rows))], f"{part} int, shard int, first long")

    @F.pandas_udf("int")
    def range_of(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, packed(high, low), side="right").astype(np.int32))

    order = Window.partitionBy(part).orderBy(h1, h2)
    placed = (keyed.withColumn(part, range_of(h1, h2)).withColumn(row_no, F.row_number().over(order))
              .join(F.broadcast(table), part))  # one row a range of range_bytes
    return placed.select(*[F.col(f"`{c}`") for c in data.columns], "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", (F.col("first") + F.col(row_no) - 1).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir) -> DataFrame:
    return (shard(read_table(spark, sf_dir, "documents"), columns=["doc_id"])
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
