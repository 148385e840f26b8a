import numpy as np
import pytest
from pyspark.sql import functions as F

from marketmood.operators import ml as ML
from marketmood.operators import training as TR


def examples(spark, seed=3, n=240, words=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 3))
        toks = [f"w{int(x)}" for x in rng.integers(0, words, 5)] + [f"w{label}"] * int(rng.integers(0, 3))
        rows.append((i, toks, label if i % 50 else None, i % 4 > 0 if i % 31 else None))
    rows += [(None, [], 1, True), (7, None, 2, True), (7, ["w1"], 9, True)]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>, label int, train boolean")


VOCAB = [f"w{i}" for i in range(6)]


def dense(tokens):
    return np.array([1.0] + [np.log1p((tokens or []).count(w)) for w in VOCAB])


def brute(rows, rounds, rate, momentum, decay=0.0):
    rows = [r for r in rows if r[2] is not None and r[2] <= 2 and r[1] is not None]
    x, y = np.array([dense(r[1]) for r in rows]), np.array([r[2] for r in rows])
    train = np.array([bool(r[3]) for r in rows])
    w, v, told = np.zeros((7, 3)), np.zeros((7, 3)), []
    for r in range(rounds):
        z = np.exp(x @ w)
        p = z / z.sum(axis=1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y])
        told.append((r, loss[train].mean(), loss[~train].mean()))
        g = x[train].T @ (p - np.eye(3)[y])[train] / train.sum()
        v = momentum * v + g + decay * w
        w = w - rate * v
    return w, told


def data_of(df):
    return df.filter("tokens IS NOT NULL").withColumn("features", TR.word_features(F.col("tokens"), VOCAB))


def test_rounds_against_brute_force(spark):
    rows, df = examples(spark)
    model = TR.train_classifier(data_of(df).repartition(5), 7, rounds=6, rate=0.7, decay=0.01)
    w, told = brute(rows, 6, 0.7, 0.9, 0.01)
    assert np.allclose(model.weights, w, atol=1e-12) and np.allclose(model.history, told, atol=1e-12)
    assert told[-1][1] < told[0][1]
    got = {r.doc_id: r for r in TR.predict_classes(data_of(df).filter("doc_id > 7"), model).collect()}
    for i, toks, *_ in rows:
        if i is not None and i > 7:
            z = np.exp(dense(toks) @ w)
            assert np.allclose([got[i].p_negative, got[i].p_neutral, got[i].p_positive], z / z.sum(), atol=1e-12)
            assert got[i].prediction == int(z.argmax())


def test_stopped_and_resumed_equals_uninterrupted(spark, tmp_path):
    _, df = examples(spark)
    data = data_of(df)
    whole = TR.train_classifier(data, 7, rounds=7)
    folder = str(tmp_path / "state")
    assert TR.load_state(spark, folder) is None
    TR.train_classifier(data, 7, rounds=3, folder=folder, save_every=2)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{folder}/state/round=6")  # a save that was cut off
    part = TR.load_state(spark, folder)
    assert part.rounds == 3 and np.allclose(part.history, whole.history[:3], atol=1e-12)
    again = TR.train_classifier(data, 7, rounds=7, folder=folder, save_every=2)
    assert np.allclose(again.weights, whole.weights, atol=1e-12) and np.allclose(again.history, whole.history, atol=1e-12)
    told = TR.history(spark, TR.load_state(spark, folder)).collect()
    assert [r["round"] for r in told] == list(range(7)) and all(r.valid_loss is not None for r in told)
    same = TR.train_classifier(data, 7, rounds=7, folder=folder)
    assert np.array_equal(same.weights, TR.load_state(spark, folder).weights)  # nothing left to do


def test_no_rows_of_a_split_and_hashed_features(spark):
    _, df = examples(spark)
    model = TR.train_classifier(data_of(df).withColumn("train", F.lit(True)), 7, rounds=2)
    assert [h[2] for h in model.history] == [None, None]
    assert TR.train_classifier(data_of(df).limit(0), 7, rounds=1).history == [(0, None, None)]
    row = spark.createDataFrame([(["a", "b", "a", "a", "c"],), ([],)], "t array<string>").select(
        TR.word_features(F.col("t"), width=1 << 16).alias("f")).collect()
    found = sorted(round(float(np.expm1(p["value"]))) for p in row[0].f[1:])
    assert found == [1, 1, 3] and [tuple(p) for p in row[1].f] == [(0, 1.0)] and row[0].f[0]["at"] == 0
    assert len({p["at"] for p in row[0].f}) == 4 and all(0 <= p["at"] < 1 << 16 for p in row[0].f)


def sequences(spark, key="symbol long"):
    rng = np.random.default_rng(1)
    rows = []
    for k, slope in ((1, 2.0), (2, -1.0), (None, 0.5)):
        for i in range(60):
            x = rng.normal(0, 1, 3)
            rows.append((k, [[float(v)] for v in x], [float(slope * x.sum() + 1)], "train" if i < 45 else "test"))
    rows.append((1, [[1.0], [None], [2.0]], [1.0], "train"))
    rows.append((9, [[1.0], [1.0], [2.0]], [1.0], "test"))
    return rows, spark.createDataFrame(rows, f"{key}, x array<array<double>>, y array<double>, split string")


def test_integer_and_missing_keys_are_series_of_their_own(spark):
    _, seq = sequences(spark)
    coefs = {r.symbol: r for r in ML.fit_forecaster(seq, ridge=0.0).collect()}
    assert set(coefs) == {1, 2, None} and {r.n_train for r in coefs.values()} == {45}
    for k, slope in ((1, 2.0), (2, -1.0), (None, 0.5)):
        assert np.allclose(coefs[k].coef, [1, slope, slope, slope])
    fc = ML.forecast(seq.filter("x[1][0] IS NOT NULL"), ML.fit_forecaster(seq, ridge=0.0))
    assert fc.schema["symbol"].dataType.simpleString() == "bigint"
    assert fc.count() == 180 and fc.filter("abs(pred[0] - y[0]) > 1e-9").count() == 0
    days = seq.withColumn("symbol", F.to_date(F.lit("2024-01-01")))
    assert ML.fit_forecaster(days).schema["symbol"].dataType.simpleString() == "date"


def test_forecaster_rounds_resume_save_and_load(spark, tmp_path):
    rows, seq = sequences(spark)
    coefs, told = TR.train_forecaster(seq, rounds=12)
    whole = {r.symbol: r.coef for r in coefs.collect()}
    x = {k: np.array([[1.0] + [v[0] for v in r[1]] for r in rows if r[0] == k and None not in [v[0] for v in r[1]]]) for k in (1, 2, None)}
    y = {k: np.array([r[2][0] for r in rows if r[0] == k and None not in [v[0] for v in r[1]]]) for k in (1, 2, None)}
    history = {(r.symbol, r["round"]): r for r in told.collect()}
    assert len(history) == 36 and 9 not in whole
    for k in (1, 2, None):
        a, b = x[k][:45], y[k][:45]
        m = a.T @ a / 45
        w = v = np.zeros(4)
        for r in range(12):
            assert np.isclose(history[k, r].train_loss, ((a @ w - b) ** 2).mean())
            assert np.isclose(history[k, r].valid_loss, ((x[k][45:] @ w - y[k][45:]) ** 2).mean())
            v = 0.9 * v + 2 * (m @ w - a.T @ b / 45)
            w = w - 0.1 / np.linalg.norm(m, 2) * v
        assert np.allclose(whole[k], w)
    folder = str(tmp_path / "state")
    TR.train_forecaster(seq, rounds=5, folder=folder, save_every=4)
    again, told = TR.train_forecaster(seq, rounds=12, folder=folder, save_every=4)
    assert {r.symbol: pytest.approx(r.coef, abs=1e-12) for r in again.collect()} == whole
    assert {(r.symbol, r["round"]): pytest.approx(r.train_loss) for r in told.collect()} == {k: r.train_loss for k, r in history.items()}
    TR.save_coefs(again, f"{tmp_path}/coefs")
    back = TR.load_coefs(spark, f"{tmp_path}/coefs")
    a = sorted((str(r.symbol), r.pred[0]) for r in ML.forecast(seq.filter("x[1][0] IS NOT NULL"), again).collect())
    assert a == sorted((str(r.symbol), r.pred[0]) for r in ML.forecast(seq.filter("x[1][0] IS NOT NULL"), back).collect())
    only = seq.withColumn("split", F.lit("train"))
    assert all(r.valid_loss is None for r in TR.train_forecaster(only, rounds=2)[1].collect())
