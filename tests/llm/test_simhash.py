import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marketmood.llm import components, simhash


def brute_fingerprint(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÄ \n\x1f\x85 b", max_size=60), st.integers(1, 5))
def test_fingerprint_matches_brute_force(text, width):
    assert simhash.fingerprint(text, width) == brute_fingerprint(text, width)


def test_fingerprint_of_text_over_a_block_and_a_chunk():
    text = " ".join(f"Wort{i % 70_001}" for i in range(150_000))
    assert len(text) > 1 << 20 and simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(600, i) for i in range(601, 640)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({n for e in edges for n in e}, edges)
    assert {n: want[n] for n in got} == got
    assert all(want[n] == n for n in want if n not in got)  # only nodes without links are left out


def test_components_of_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_are_exact_on_random_values(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {0, (1 << 64) - 1, *base}
    for v in base:
        for bits in (1, 3, 4, 5, 6):
            w = v
            for b in rng.sample(range(64), bits):
                w ^= 1 << b
            values.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    from marketmood.llm.common import stored
    links = [(r["u"], r["v"]) for r in simhash.near_links(stored(df, "values"), 4, tile_rows=8).collect()]
    wide = lambda v: v & ((1 << 64) - 1)
    assert all(bin(wide(a) ^ wide(b)).count("1") <= 4 for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin(wide(a) ^ wide(b)).count("1") <= 4]
    assert brute_components(signed, links) == brute_components(signed, near)


def test_documents_against_brute_force(docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    by_fp = {}
    for i, f in rows:
        by_fp.setdefault(f, []).append(i)
    fps = list(by_fp)
    near = [(min(by_fp[a]), min(by_fp[b])) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4]
    links = near + [(ids[0], x) for ids in by_fp.values() for x in ids]
    want = brute_components([i for i, _ in rows], links)
    got = simhash.near_duplicates(docs, tile_rows=100).collect()
    assert {r["row_id"]: (r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in got} == {i: (f, want[i]) for i, f in rows}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_edges_cases(edge_docs, no_docs):
    found = simhash.near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    by_id = {r["row_id"]: r for r in found}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1
    assert by_id[3]["fp"] == by_id[4]["fp"] == by_id[5]["fp"] == 0 and by_id[5]["component_id"] == 3
    assert [r["component_id"] for r in found if r["row_id"] is None and r["fp"]] == [None]
    assert [r["component_id"] for r in found if r["row_id"] is None and not r["fp"]] == [3]
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and kept.schema == edge_docs.schema
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 3), (False, 6), (False, 7), (False, 9), (False, 9), (False, 10), (True, 0)]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_many_near_copies_give_one_component(spark):
    base = [f"t{k}" for k in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[i] = f"u{i}"
        rows.append((i, " ".join(words)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=6, tile_rows=32)
    assert found.select("component_id").distinct().count() <= 3
