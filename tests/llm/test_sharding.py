import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketmood.llm import sharding as S


def check(rows, texts, shards=8, tolerance=0.002):
    """Sizes, checksums, gapless slots, and shares within the tolerance or one row."""
    by = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r)
    total, most = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        share = sum(r["size"] for r in own)
        assert abs(share - total / shards) <= 2 * tolerance * total / shards + most
    assert set(by) <= set(range(shards))


def test_documents(spark, docs):
    from marketmood.llm.queries import QUERIES
    rows = QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


@pytest.mark.parametrize("share", [0.34, 1.0])
def test_hot_group_of_copies_is_split(spark, share):
    n = 4000
    texts = {i: "copy of one text" if i < share * n else f"text number {i * 7919 % 4001} " + "x" * (i % 30) for i in range(n)}
    rows = S.shard(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(rows, texts)
    assert len({r["shard"] for r in rows}) == 8
    apart = {t: {r["shard"] for r in rows if texts[r["doc_id"]] == t} for t in set(texts.values()) if t[0] == "t"}
    assert all(len(s) <= 2 for s in apart.values())


def test_same_layout_for_any_partitioning(spark, docs):
    layout = lambda d: {(r["doc_id"], r["shard"], r["slot"]) for r in S.shard(d, 5).collect()}
    assert layout(docs) == layout(docs.repartition(9))


def test_histogram_counts_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(-3, 3, 500), rng.integers(-2**63, 2**63 - 1, 500), rng.integers(1, 90, 500))]
    key = lambda a, b: (a + (1 << 63)) << 64 | (b + (1 << 63))
    probes = sorted(key(a, b) for a, b, _ in rows[:40])
    got = S.histogram(spark.createDataFrame(rows, "h1 long, h2 long, size long").repartition(5), probes)
    for i, p in enumerate(probes):
        assert got["bytes"].fillna(0)[:i + 1].sum() == sum(c for a, b, c in rows if key(a, b) < p)
        assert got["rows"].fillna(0)[:i + 1].sum() == sum(key(a, b) < p for a, b, _ in rows)


def test_edge_cases(spark, edge_docs, no_docs):
    out = S.shard(edge_docs.selectExpr("*", "7 AS slot", "1 AS key_range"))
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    assert {"fp", "key_range", "h1", "bucket", "slot"} <= set(out.columns) and out.columns.count("slot") == 1
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["text"] is not None or (r["size"], r["text_crc32"]) == (1, 0)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert S.shard(no_docs).count() == 0
    one = S.shard(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["size"], r["slot"]) for r in one] == [(1, 0)]


def test_equal_rows_and_missing_ids_are_parted(spark):
    """A third of the rows repeat one id and text, another third has no id."""
    rows = [(i, f"text number {i} " * (1 + i % 3)) for i in range(3000)] + [(7, "the same row again and again")] * 3000
    rows += [(None, f"no id {i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.shard(df, shards=8).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    total = sum(sizes.values())
    assert len(got) == 9000 and sorted(sizes) == list(range(8))
    assert all(abs(v - total / 8) <= 0.002 * total / 8 + 60 for v in sizes.values()), sizes
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    fine = S.shard(df, shards=4, range_bytes=2000, columns=["doc_id"])
    assert fine.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and fine.count() == 9000
