import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketmood.llm import packing

ENCODER = packing.Encoder(packing.vocabulary_path())


def library_ids(text):
    return [*ENCODER.tok.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180), st.characters(codec="utf-8"), st.sampled_from("'s <|>tİſ")), max_size=40))
def test_ids_equal_the_library(text):
    assert ENCODER.encode(text) == ENCODER.whole(text)


def test_special_strings_and_every_latin_character():
    for text in ("a<|endoftext|>b", "<|startoftext|>", "don't 'S it's''s", "x" * 300):
        assert ENCODER.encode(text) == ENCODER.whole(text)
    for c in range(0x180):
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}x'{chr(c)}s {chr(c)}"
        assert ENCODER.encode(text) == ENCODER.whole(text), c


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10_000), st.sampled_from([7, 64, 2048]), st.floats(0.5, 1.0))
def test_cuts_cover_and_fill(length, capacity, fill):
    parts = packing.cuts(length, capacity, fill)
    assert sum(parts) == length and all(0 < p <= capacity for p in parts)
    assert all((capacity // p) * p >= fill * capacity or (capacity // p) * p > capacity - (capacity // p) for p in parts)


def check(pieces, ids_of, capacity=2048):
    """Exact round trip of every document and gapless sequences; returns padding and tokens."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for key, own in docs.items():
        own.sort(key=lambda p: p["start"])
        data = b"".join(p["ids"] for p in own)
        assert np.frombuffer(data, "<u4").tolist() == ids_of[key]
        assert all(p["doc_tokens"] == len(ids_of[key]) for p in own)
    assert docs.keys() == ids_of.keys()
    waste = total = 0
    for own in seqs.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste, total


def test_documents_round_trip_with_little_padding(docs):
    rows = {r["doc_id"]: library_ids(r["text"]) for r in docs.collect()}
    pieces = packing.pack(docs, packing.vocabulary_path(), with_ids=True).collect()
    waste, total = check(pieces, rows)
    assert waste / total < 0.03


def test_many_workers(spark, docs):
    rows = {r["doc_id"]: library_ids(r["text"]) for r in docs.limit(200).collect()}
    few = docs.limit(200).repartition(7)
    waste, total = check(packing.pack(few, packing.vocabulary_path(), with_ids=True).collect(), rows)
    assert waste <= 7 * 2 * 2048 + 0.03 * total


def test_full_bins_hold_a_fixed_count():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 2048)
        for p in packing.cuts(n):
            assert (2048 // p) * p <= 2048 < (2048 // p + 1) * p


def test_edge_cases(edge_docs, no_docs):
    pieces = packing.pack(edge_docs, packing.vocabulary_path()).collect()
    assert sum(p["start"] == 0 for p in pieces) == edge_docs.count()
    for i in (3, 4, 5):
        (p,) = [p for p in pieces if p["doc_id"] == i]
        assert (p["length"], p["doc_tokens"], p["ids_crc32"]) == (1, 1, zlib.crc32(b"\1\0\0\0"))
    assert sum(p["doc_id"] is None and p["start"] == 0 for p in pieces) == 2
    assert packing.pack(no_docs, packing.vocabulary_path()).count() == 0
