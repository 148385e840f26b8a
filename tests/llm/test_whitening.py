from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketmood.llm import whitening as wh


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    m = (q * values) @ q.T
    return (m + m.T) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, 1.0, 2.0, 2.5, 1e-3]), min_size=1, max_size=24), st.integers(0, 99))
def test_inertia_counts_eigenvalues(values, seed):
    assert wh.positive_pivots(symmetric(np.array(values), seed)) == sum(x > 0 for x in values)


def test_inertia_of_matrices_that_need_two_by_two_pivots():
    assert wh.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    a = np.zeros((6, 6))
    for i in range(0, 6, 2):
        a[i, i + 1] = a[i + 1, i] = i + 1
    assert wh.positive_pivots(a) == 3 and wh.positive_pivots(np.zeros((3, 3))) == 0


SPECTRA = {
    "spread": np.arange(1, 65.0), "near": 60 + np.arange(64) / 100, "equal": np.full(40, 7.0),
    "pairs": np.repeat(np.arange(1, 21.0), 2), "steep": 10.0 ** -np.arange(30), "rank 5": np.r_[np.zeros(35), 1, 2, 3, 4, 5.0],
    "one hot": np.r_[np.ones(63), 1000.0], "tight end": np.r_[np.ones(30), 2 + 1e-9 * np.arange(20)], "one": np.array([3.0]),
    "cut in a group": np.r_[np.ones(40), np.full(10, 5.0), np.full(12, 9.0)]}


@pytest.mark.parametrize("name", SPECTRA)
def test_contour_pairs_match_the_spectrum(name):
    values = np.sort(SPECTRA[name])[::-1]
    v = symmetric(values, 3)
    got, vectors = wh.top_pairs(v, 16)
    want = values[values > 1e-12][:16]
    want = want if name != "steep" else values[:len(got)]
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-13 * values[0] * len(v))
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert np.linalg.norm(v @ vectors - vectors * got, axis=0).max() < 1e-12 * values[0]


def test_no_eigenvalue_above_rounding():
    assert len(wh.top_pairs(np.zeros((5, 5)), 16)[0]) == 0 and len(wh.top_pairs(np.zeros((0, 0)), 16)[0]) == 0


def test_contour_keeps_only_the_interval():
    v = symmetric(np.arange(1, 41.0))
    values, vectors = wh.interval_pairs(v, 10.5, 14.5, 4, 40.0)
    assert np.allclose(values, [11, 12, 13, 14])
    with pytest.raises(ArithmeticError):
        wh.interval_pairs(v, 10.5, 14.5, 5, 40.0)


def brute(rows):
    """By vec_id: exact deviation; and whitened values, explained shares from a dense eigensolver."""
    ints = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in ints})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in fit])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, int((e > 1e-9).sum()))
    out = []
    for i, x in ints:
        y = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)]) @ u[:, :k] / np.sqrt(e[:k])
        out.append((i, n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), y, e[:k] / e.sum()))
    return out, k


def compare(df, rows):
    out = wh.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {}
    for r in out.collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    want, k = brute(rows)
    assert sum(map(len, got.values())) == len(rows) * k
    signs = None
    for i, n, deviation, y, explained in want:
        own = sorted(got[i, deviation], key=lambda r: r["component"])
        own = own[::len(own) // k]
        assert [r["component"] for r in own] == list(range(1, k + 1))
        assert {r["n"] for r in own} == {n} and len({r["identity_error"] for r in own}) == 1
        assert own[0]["identity_error"] < 1e-9
        z = np.array([r["whitened"] for r in own])
        signs = np.sign(z * y) if signs is None else signs
        assert np.allclose(z * signs, y, atol=1e-7)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)


def test_given_embeddings_against_a_dense_solver(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate((rng.normal(0, 1, (60, 20)) * np.arange(1, 21)).tolist())]
    rows += [rows[3], rows[3], (None, rows[5][1]), (3, rows[6][1]), (99, rows[7][1])]
    bad = [(70, None), (71, [None] + [1.0] * 19), (72, [float("nan")] * 20), (73, [float("-inf")] + [0.0] * 19), (74, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for name in ("x", "n", "component", "WHITENED"):
        df = df.selectExpr("*", f"'y' AS {name}")
    compare(df, rows)
    compare(df.repartition(5), rows)
    narrow = [(i, v[:3]) for i, v in rows]
    compare(spark.createDataFrame(narrow, "vec_id long, embedding array<double>"), narrow)


def test_few_vectors_give_few_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0, -1.0 * i]) for i in (0, 1, 5)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert wh.whiten(same).count() == 0 and wh.whiten(same.limit(0)).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        wh.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_wide_entries_are_summed_exactly(spark):
    rng = np.random.default_rng(8)
    ints = rng.integers(-(1 << 29), 1 << 29, (300, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in ints.astype(int)], "x array<int>").repartition(3)
    n, sums = wh.column_sums(df, 6)
    v, most, trace = wh.covariance(df, n, sums)
    big = [[int(x) for x in row] for row in ints]
    want = [[Fraction(sum(300 * r[i] * r[j] for r in big) - sums[i] * sums[j], 300 * 300) for j in range(6)] for i in range(6)]
    assert (n, sums) == (300, [sum(r[i] for r in big) for i in range(6)])
    assert v.tolist() == [[float(x) for x in row] for row in want] and trace == float(sum(want[i][i] for i in range(6)))
