import numpy as np
import pytest

from marketmood.llm import cross_polytope as cp


def test_hadamard_is_the_matrix():
    h = np.ones((1, 1))
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).standard_normal((7, 16))
    assert np.allclose(cp.hadamard(x), x @ h / 4)
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("dim, polytopes, count", [(5, 1, 7), (8, 2, 40), (3, 3, 100), (1, 1, 2)])
def test_probes_are_the_nearest_buckets_in_order(dim, polytopes, count):
    index = cp.Index(dim, 2, polytopes)
    x = np.random.default_rng(2).standard_normal((6, dim))
    got = index.probes(x, count)
    assert (got[:, 0] == index.hashes(x)[:, 0]).all() and (got[:, got.shape[1] // 2] == index.hashes(x)[:, 1]).all()
    away = [(index.turned(x, 0, p).max(axis=1, keepdims=True) - index.turned(x, 0, p)) ** 2 for p in range(polytopes)]
    for i in range(len(x)):
        sums = np.zeros(1)
        for a in away:
            sums = (sums[:, None] + a[i]).ravel()
        best = np.sort(sums)[:count]
        assert np.allclose(sums[got[i, :got.shape[1] // 2]], best)


def test_near_vectors_share_buckets_more_often():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 64))
    index = cp.Index(64, 1, 1)
    near, far = a + 0.3 * rng.standard_normal(a.shape), rng.standard_normal(a.shape)
    share = [(index.hashes(a) == index.hashes(b)).mean() for b in (near, far)]
    assert share[0] > 0.45 and share[1] < 0.03
    assert (index.hashes(a) == index.hashes(a * 1e-3)).all()


def brute(rows, k=10):
    """For each query row its k nearest other rows by (distance, vec_id)."""
    out = []
    x = np.array([v for _, v in rows], np.float64)
    for i, (q, _) in enumerate(rows):
        if q is not None and q % 100 == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            best = sorted((d[j], rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i)[:k]
            out += [(q, r + 1, None if none else j, s) for r, (s, none, j) in enumerate(best)]
    return out


def result(out):
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(r) for r in out.collect()]


def recall(got, want):
    got = {(q, i) for q, _, i, _ in got}
    return sum((q, i) in got for q, _, i, _ in want) / len(want)


def every_100th(i):
    return i % 100 == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_given_embeddings_against_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows), result(cp.search(df, every_100th))
    assert recall(got, want) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    by_query = {}
    for q, r, i, s in got:
        assert q != i and abs(s - np.linalg.norm(exact[q] - exact[i])) < 1e-12
        by_query.setdefault(q, []).append((r, s, i))
    assert sorted(by_query) == sorted({q for q, *_ in want})
    for found in by_query.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)


def test_edges(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(0, 1, 6)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (250, 6)).round(1).tolist())]
    rows += [(300 + i, (near + 1e-3 * rng.normal(0, 1, 6)).tolist()) for i in range(200)]  # a hot bucket
    rows += [rows[100], rows[100], (None, rows[200][1]), (100, rows[7][1]), (401, [1e5] * 6), (402, [1e-5] * 6)]
    bad = [(1100, None), (1200, [None] + [1.0] * 5), (1300, [float("nan")] * 6), (1400, [float("inf")] + [0.0] * 5),
           (1500, [0.0] * 6), (1600, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    for name in ("uid", "code", "RANK", "score", "tile"):
        df = df.selectExpr("*", f"'x' AS {name}")
    all_buckets = cp.Settings(target=1.1, tile_rows=16, part_queries=2)
    key = lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0)
    got, want = result(cp.search(df, every_100th, settings=all_buckets)), brute(rows)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12
    assert recall(result(cp.search(df.repartition(6), every_100th)), want) >= 0.9
    assert cp.search(df.limit(0), every_100th).count() == 0 and cp.search(df.filter("vec_id > 1000"), every_100th).count() == 0


def test_few_rows_give_all_others(spark):
    rows = [(i, [float(i + 1), float(7 - i)]) for i in (0, 100, 200, 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(result(cp.search(df, every_100th)))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(brute(rows))]
    assert cp.search(df.filter("vec_id = 100"), every_100th).count() == 0
    assert cp.search(df.filter("vec_id % 100 <> 0"), every_100th).count() == 0


def test_short_queries_probe_further_and_more_polytopes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (600, 8)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(cp.search(df, every_100th, settings=cp.Settings(target=0.0, bucket_rows=2)))  # one probe of 256 buckets
    assert len(got) == 60 and {r[1] for r in got} == set(range(1, 11))
    assert recall(result(cp.search(df, every_100th, settings=cp.Settings(bucket_rows=2))), brute(rows)) >= 0.9
