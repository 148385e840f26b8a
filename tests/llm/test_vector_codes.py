import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketmood.llm import vector_codes as vc


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_limb_products_are_exact(data):
    n, k, m = (data.draw(st.integers(1, 6)) for _ in range(3))
    bits = data.draw(st.integers(1, 30)), data.draw(st.integers(1, 29))
    a, b = (np.array(data.draw(st.lists(st.integers(-(1 << w), 1 << w), min_size=x * y, max_size=x * y)), np.int64).reshape(x, y)
            for w, (x, y) in zip(bits, ((n, k), (k, m))))
    want = a.astype(object) @ b.astype(object)
    for least in (1, 2, 3):
        assert (vc.exact_product(a, b, least) == want).all()


def test_limbs_of_wide_integers():
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 45), 1 << 45, (30, 50))
    b = rng.integers(-(1 << 10), 1 << 10, (50, 20))
    assert (vc.exact_product(a, b) == a.astype(object) @ b.astype(object)).all()
    assert (a.astype(float) @ b.astype(float) != vc.exact_product(a, b)).any()  # one float product isn't exact
    with pytest.raises(OverflowError):
        vc.exact_product(a, b << 20)


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain Python over (vec_id, vector, label), one part at a time."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(256 * float(x))) for x in r[1]] for r in rows]
    w = len(ints[0]) // parts
    books = [[v[p * w:(p + 1) * w] for v in ints[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            found = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], c)) for c in books[p]]
                found.append((d.index(min(d)), min(d)))
            out.append(found)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * w:(p + 1) * w] for v, f in zip(ints, found) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [("".join(f"{i:02x}" for i, _ in f), sum(d for _, d in f)) for f in assign()]
    by_label = {}
    for r, (_, e) in zip(rows, coded):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], c, e, by_label[r[2]], sha) for r, (c, e) in zip(rows, coded)), key=str)


def result(df, **names):
    out = vc.compress(df, **names)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(0, 1, (140, 32)).round(3).tolist()
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vecs)]
    rows += [rows[7], rows[7], (7, vecs[9], 1), (None, vecs[4], 2), (None, vecs[4], None), (500, [0.0] * 32, 9),
             (501, [1000.25] * 32, 9)]
    bad = [(600, None, 1), (601, [None] + [0.5] * 31, 1), (602, [float("nan")] * 32, 1), (603, [float("inf")] + [0.0] * 31, 1),
           (604, [], 2)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    for name in ("code", "error", "vector", "of", "V"):
        df = df.selectExpr("*", f"'x' AS {name}")
    want = brute(rows)
    assert result(df) == want
    assert result(df.repartition(7)) == want
    few = df.filter("vec_id < 20")
    assert result(few) == brute([r for r in rows if r[0] is not None and r[0] < 20])
    assert vc.compress(df.limit(0)).count() == 0 and vc.compress(df.filter("vec_id >= 600")).count() == 0


def test_decode_gives_the_error(spark):
    df = spark.createDataFrame([(i, np.sin(np.arange(16) * (i + 1)).tolist(), 0) for i in range(100)],
                               "vec_id long, embedding array<float>, label int")
    books = vc.train_books(df, "vec_id", "embedding")
    for r in vc.encode(df, "embedding", books, ["vec_id", "embedding"]).collect():
        x = np.floor(256 * np.array(r["embedding"])).astype(int)
        assert ((x - vc.decode(r["code"], books)) ** 2).sum() == r["error"]


def test_other_lengths_raise(spark):
    for vecs in ([[0.5] * 32, [0.5] * 16], [[0.5] * 20] * 3):
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
        with pytest.raises(ValueError):
            vc.compress(df)
