import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marketmood.llm import minhash as M

H = M.Hasher()


def shingles(text, width=5):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} or ({b" ".join(words)} if words else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "ab", "é", "日本", "x1"]), max_size=12), st.sampled_from([" ", "\n", " \t "]))
def test_shingle_hashes_tell_shingles_apart(words, gap):
    text = gap.join(words)
    found = [h for part in H.shingles(text) for h in part.tolist()]
    assert len(found) == max(1 if words else 0, len(words) - 4)
    assert len(set(found)) == len(shingles(text))
    again = [h for part in H.shingles("  " + " ".join(words).upper() if text.isascii() else text) for h in part.tolist()]
    assert again == found


def test_long_text_is_hashed_block_by_block():
    words = [f"w{i}" for i in range(250_000)]
    text = " ".join(words)
    parts = list(H.shingles(text))
    assert len(parts) > 1 and sum(map(len, parts)) == len(words) - 4
    tail = np.concatenate(list(H.shingles(" ".join(words[-50:]))))
    assert np.array_equal(np.concatenate(parts)[-46:], tail)


def test_signature_is_the_minimum_of_each_permutation():
    text = " ".join(f"w{i}" for i in range(700))
    x = np.concatenate(list(H.shingles(text)))
    want = [min((int(v) * int(a) + int(b)) % (1 << 64) for v in x) for a, b in zip(H.mul.ravel()[:5], H.add.ravel()[:5])]
    assert H.signature(text)[:5].tolist() == want


def brute_rows(rows):
    """Rows by descending id (nulls last, equal ids by the given order) with their next text."""
    out = {}
    for i, (k, t) in enumerate(rows):
        following, n = rows[(i + 1) % len(rows)][1], len(t)
        made = t[:n - n // 2] + following[:n // 2]
        out[k] = (n, hashlib.sha256(made.encode()).hexdigest(), jaccard(shingles(t), shingles(made)),
                  jaccard(shingles(t), shingles(following)))
    return out


def test_query_against_brute_force(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    want = brute_rows(rows)
    for buckets in (1, 3, 200):
        got = {r["doc_id"]: r for r in M.edit_fingerprints(docs, buckets=buckets).collect()}
        assert got.keys() == want.keys()
        assert all((r["n_chars"], r["edited_sha256"]) == want[k][:2] for k, r in got.items())
    error = [abs(r["near_edited"] - want[k][2]) for k, r in got.items()] + [abs(r["near_next"] - want[k][3]) for k, r in got.items()]
    assert np.mean(error) < 0.03 and max(error) < 0.25
    prints = {}
    for k, t in rows:
        assert prints.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert len(set(prints.values())) > 0.9 * len(prints)


def test_edge_cases(spark, edge_docs, no_docs):
    got = M.edit_fingerprints(edge_docs, buckets=4).collect()
    assert len(got) == edge_docs.count()
    empty = {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert empty == {"ffff" * M.PERMUTATIONS}
    assert M.edit_fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    (r,) = M.edit_fingerprints(one).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c da b c ").hexdigest()
    nulls = spark.createDataFrame([(None, "x"), (None, "y z"), (3, None)], "doc_id long, text string")
    assert M.edit_fingerprints(nulls).count() == 3


def test_similar_pairs_against_brute_force(spark, docs):
    words = [f"t{k}" for k in range(60)]
    near = [(10_000 + i, " ".join([*words[:i], f"u{i}", *words[i + 1:]])) for i in range(12)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(near + near[:2], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    pairs, members = M.similar_pairs(more)
    text_of = {r["class_id"]: dict(rows)[r["row_id"]] for r in members.collect()}
    assert members.count() == len(rows)
    sets = {c: shingles(t) for c, t in text_of.items()}
    by = {}
    for c, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(c)
    met = {(a, b) for cs in by.values() if len(cs) < 300 for a in cs for b in cs if a < b}
    want = {(a, b) for a, b in met if jaccard(sets[a], sets[b]) >= 0.8}
    got = pairs.collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(want) > 10
    assert all(abs(r["jaccard"] - jaccard(sets[r["a"]], sets[r["b"]])) < 1e-12 for r in got)
    groups = {r["row_id"]: r for r in M.near_duplicate_groups(more).collect()}
    assert {groups[k]["group_id"] for k, _ in near} == {10_000}
