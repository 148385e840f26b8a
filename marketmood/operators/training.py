"""Training in rounds with saved state (S5, M2, M8): text classifier and price forecaster.

A round of the classifier is one pass over the feature rows: each task adds up
the gradient of the features it meets and the losses of both splits, Spark sums
them by feature, and the driver moves the weights (features x classes numbers).
The forecaster's rounds need no pass: its loss is a quadratic form of sums that
are gathered once, so all rounds of a symbol run on a p x p matrix.

After every ``save_every`` rounds weights, momentum and history are written to
the state folder; a marker is written last, so a stop while saving leaves the
older state in force. Training that starts on a folder with a state goes on
from it and ends like training that never stopped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.text import decode_label
from marketmood.operators.ml import window_sums


# ---------------------------------------------------------------- state folders
def _done(spark: SparkSession, folder: str) -> int | None:
    """The newest round whose state is complete."""
    try:
        return spark.read.option("basePath", f"{folder}/done").parquet(f"{folder}/done/round=*").agg(F.max("round")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _save(state: DataFrame, folder: str, rounds: int) -> None:
    state.write.mode("overwrite").parquet(f"{folder}/state/round={rounds}")
    state.sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}/done/round={rounds}")


# ---------------------------------------------------------------- classifier
@dataclass
class Trained:
    """Weights (features x classes), momentum and the losses so far: ``(round, train_loss, valid_loss)``."""
    weights: np.ndarray
    speed: np.ndarray
    history: list[tuple[int, float | None, float | None]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        """Rounds that the weights have seen."""
        return len(self.history)


def word_features(tokens: Column, words: list[str] | None = None, width: int = 1 << 18) -> Column:
    """Features of a token array as ``array<struct<at, value>>``: ln(1 + count) by word, and a constant at 0.

    With ``words`` (a short list) word i has place i + 1, other words are left
    out; without, words share ``width`` - 1 places by their hash.
    """
    if words is not None:
        def count(word):
            return F.size(F.filter(tokens, lambda t: t == word))

        pairs = [F.struct(F.lit(i + 1).alias("at"), count(w).alias("n")) for i, w in enumerate(words)]
        counts = F.filter(F.array(*pairs), lambda p: p["n"] > 0)
    else:
        places = F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(width - 1)) + 1).cast("int"))
        # sorted places, and where each run of one place ends: a count is the distance of two ends
        places = F.array_sort(places)
        ends = F.filter(F.transform(places, lambda p, i: F.when(
            F.coalesce(F.get(places, i + 1) != p, F.lit(True)), F.struct(p.alias("at"), (i + 1).alias("end")))),
            lambda e: e.isNotNull())
        counts = F.transform(ends, lambda e, i: F.struct(e["at"].alias("at"), (
            e["end"] - F.coalesce(F.get(ends, i - 1)["end"], F.lit(0))).alias("n")))
    one = F.array(F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("value")))
    return F.concat(one, F.transform(counts, lambda p: F.struct(p["at"].alias("at"), F.log1p(p["n"].cast("double")).alias("value"))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and value of every feature of a batch."""
    flat, at = column.flatten(), column.offsets.to_numpy()
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    return rows, flat.field("at").to_numpy(), flat.field("value").to_numpy()


def _scores(rows, places, values, weights, n) -> np.ndarray:
    parts = weights[places] * values[:, None]
    return np.stack([np.bincount(rows, parts[:, k], n) for k in range(weights.shape[1])], axis=1)


def _pass(data: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[float, int]]]:
    """Summed gradient over the training rows; summed loss and count of the training (1) and validation (0) rows."""
    width, classes = weights.shape

    def partial(batches):
        grad, seen, loss = np.zeros((width, classes)), np.zeros(width, bool), np.zeros((2, 2))
        for batch in batches:
            label, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            n = len(label)
            rows, places, values = _entries(batch.column(2))
            p = _softmax(_scores(rows, places, values, weights, n))
            own = -np.log(np.maximum(p[np.arange(n), label], 1e-300))
            loss[:, 0] += np.bincount(train, own, 2)
            loss[:, 1] += np.bincount(train, minlength=2)
            p[np.arange(n), label] -= 1
            p[train == 0] = 0
            np.add.at(grad, places, p[rows] * values[:, None])
            seen[places] = True
        at = np.append(np.flatnonzero(seen), [-1, -2])
        out = np.concatenate([grad[seen], np.pad(loss, ((0, 0), (0, classes - 2)))])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(out[:, k]) for k in range(classes)]],
                                         names=["at", *[f"g{k}" for k in range(classes)]])

    schema = "at long, " + ", ".join(f"g{k} double" for k in range(classes))
    rows = (data.select("label", "train", "features").mapInArrow(partial, schema).groupBy("at")
            .agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(classes)]).collect())
    grad, loss = np.zeros((width, classes)), {}
    for r in rows:
        if r["at"] < 0:
            loss[r["at"] + 2] = (r["g0"], int(r["g1"]))  # -1 sums what was not trained on, -2 what was
        else:
            grad[r["at"]] = r[1:]
    return grad, {0: loss.get(1, (0.0, 0)), 1: loss.get(0, (0.0, 0))}


def _state_rows(model: Trained) -> pd.DataFrame:
    at, k = np.indices(model.weights.shape).reshape(2, -1)
    weights = pd.DataFrame({"kind": "weight", "at": at, "k": k, "a": model.weights.ravel(), "b": model.speed.ravel()})
    history = pd.DataFrame([("loss", r, 0, a, b) for r, a, b in model.history], columns=["kind", "at", "k", "a", "b"])
    return pd.concat([weights, history], ignore_index=True).astype({"at": "int64", "k": "int64", "a": "float64", "b": "float64"})


def save_state(spark: SparkSession, model: Trained, folder: str) -> None:
    """Write weights, momentum and history of a classifier."""
    rows = spark.createDataFrame(_state_rows(model), "kind string, at long, k long, a double, b double")
    _save(rows, folder, model.rounds)


def load_state(spark: SparkSession, folder: str) -> Trained | None:
    """The newest complete state in a folder, None without one."""
    last = _done(spark, folder)
    if last is None:
        return None
    rows = spark.read.parquet(f"{folder}/state/round={last}").toPandas()
    w, loss = rows[rows.kind == "weight"], rows[rows.kind == "loss"].sort_values("at")
    shape = int(w["at"].max()) + 1, int(w["k"].max()) + 1
    model = Trained(np.zeros(shape), np.zeros(shape))
    model.weights[w["at"], w["k"]], model.speed[w["at"], w["k"]] = w["a"], w["b"]
    none = lambda x: None if np.isnan(x) else float(x)
    model.history = [(int(r), none(a), none(b)) for r, a, b in zip(loss["at"], loss["a"], loss["b"])]
    return model


def train_classifier(data: DataFrame, width: int, classes: int = 3, rounds: int = 20, rate: float = 0.5,
                     momentum: float = 0.9, decay: float = 0.0, folder: str | None = None, save_every: int = 5) -> Trained:
    """M2/M8: multinomial logistic regression by full gradients, ``rounds`` of them in all.

    ``data`` has ``label`` (0 to classes - 1; rows without one are left out),
    ``train`` (rows where it is not true are the validation rows) and
    ``features`` (see :func:`word_features`); store it, as each round reads it.
    Round r of the history holds the mean losses of the weights before the
    round's step; NULL for a split without rows. With ``folder`` training goes
    on from the state there and saves its own.
    """
    spark = data.sparkSession
    data = data.filter(F.col("label").between(0, classes - 1)).select(
        F.col("label").cast("long").alias("label"), F.coalesce("train", F.lit(False)).alias("train"), "features")
    model = load_state(spark, folder) if folder else None
    model = model or Trained(np.zeros((width, classes)), np.zeros((width, classes)))
    saved = model.rounds
    while model.rounds < rounds:
        grad, loss = _pass(data, model.weights)
        mean = [s / n if n else None for s, n in (loss[1], loss[0])]
        model.speed = momentum * model.speed + grad / max(1, loss[1][1]) + decay * model.weights
        model.weights = model.weights - rate * model.speed
        model.history.append((model.rounds, *mean))
        if folder and (model.rounds % save_every == 0 or model.rounds == rounds) and model.rounds > saved:
            save_state(spark, model, folder)
    return model


def history(spark: SparkSession, model: Trained, name: str = "sentiment") -> DataFrame:
    """M8: ``(model, round, train_loss, valid_loss)``; a loaded model has its whole history."""
    return spark.createDataFrame([(name, *h) for h in model.history],
                                 "model string, round int, train_loss double, valid_loss double")


def predict_classes(data: DataFrame, model: Trained, keep=("doc_id",)) -> DataFrame:
    """M3: ``(keep..., prediction, label_name, p_negative, p_neutral, p_positive)`` of rows with ``features``."""
    weights = model.weights

    def scores(batches):
        for batch in batches:
            p = _softmax(_scores(*_entries(batch.column(batch.num_columns - 1)), weights, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.argmax(axis=1)), *[pa.array(p[:, k]) for k in range(3)]],
                                             names=[*keep, "prediction", "p_negative", "p_neutral", "p_positive"])

    schema = data.select(*keep, F.lit(0).cast("long").alias("prediction"),
                         *[F.lit(0.0).alias(c) for c in ("p_negative", "p_neutral", "p_positive")]).schema
    out = data.select(*keep, "features").mapInArrow(scores, schema)
    return out.select(*keep, "prediction", decode_label("prediction").alias("label_name"), "p_negative", "p_neutral", "p_positive")


# ---------------------------------------------------------------- forecaster
def save_coefs(coefs: DataFrame, path: str) -> None:
    """Write forecaster coefficients ``(key, coef, ...)``."""
    coefs.write.mode("overwrite").parquet(path)


def load_coefs(spark: SparkSession, path: str) -> DataFrame:
    """Coefficients written by :func:`save_coefs`, ready for ``forecast``."""
    return spark.read.parquet(path)


def train_forecaster(seq: DataFrame, key: str = "symbol", rounds: int = 100, rate: float | None = None,
                     momentum: float = 0.9, split: str = "split", train_value: str = "train",
                     folder: str | None = None, save_every: int = 50) -> tuple[DataFrame, DataFrame]:
    """M5/M8: linear forecasters by gradient steps, one a key.

    Returns ``(key, coef, n_train)`` for ``forecast`` and the history ``(key,
    round, train_loss, valid_loss)``: mean squared errors before each step on the
    training rows and on all others (NULL without any). ``rate`` None takes
    (1 - momentum) over the largest eigenvalue of the key's mean square matrix,
    which can't diverge. Keys without training rows are left out. ``folder``
    works as in :func:`train_classifier`.
    """
    spark, kind = seq.sparkSession, seq.schema[key].dataType
    sums = window_sums(seq, key, F.coalesce(F.col(split) == train_value, F.lit(False)))
    schema = "_k string, xx array<double>, n long, vv array<double>, m long, coef array<double>, speed array<double>, losses array<double>"
    start = sums.groupBy("_k").agg(*[F.first(F.when(F.col("part") == p, F.col(c)), ignorenulls=True).alias(a)
                                     for p, c, a in ((True, "xx", "xx"), (True, "n", "n"), (False, "xx", "vv"), (False, "n", "m"))])
    zeros = F.array_repeat(F.lit(0.0), (F.sqrt(F.size("xx").cast("double")) - 1).cast("int"))
    state = start.filter("n > 0").select("_k", "xx", "n", "vv", "m", zeros.alias("coef"), zeros.alias("speed"),
                                         F.array().cast("array<double>").alias("losses"))
    done = _done(spark, folder) if folder else None
    if done is not None:
        state = spark.read.schema(state.schema).parquet(f"{folder}/state/round={done}")
    done = done or 0

    def steps(count):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in pdf.itertuples(index=False):
                w, v, losses = np.array(r.coef, float), np.array(r.speed, float), list(r.losses)
                p = len(w)
                full = [None if x is None else np.array(x, float).reshape(p + 1, p + 1) for x in (r.xx, r.vv)]
                sizes = [r.n, r.m]
                a = full[0][:p, :p] / r.n
                step = rate if rate is not None else (1 - momentum) / max(np.linalg.norm(a, 2), 1e-300)
                for _ in range(count):
                    u = np.append(w, -1.0)  # the sum of squared errors is u' M u
                    losses += [np.nan if m is None else float(u @ m @ u) / n for m, n in zip(full, sizes)]
                    v = momentum * v + 2 * (a @ w - full[0][:p, p] / r.n)
                    w = w - step * v
                out.append((r[0], r.xx, r.n, r.vv, r.m, w.tolist(), v.tolist(), losses))
            return pd.DataFrame(out, columns=["_k", "xx", "n", "vv", "m", "coef", "speed", "losses"]).astype({"m": "Int64"})
        return run

    while done < rounds:
        count = min(save_every - done % save_every, rounds - done) if folder else rounds - done
        state = state.groupBy("_k").applyInPandas(steps(count), schema)
        done += count
        if folder:
            _save(state, folder, done)
            state = spark.read.schema(state.schema).parquet(f"{folder}/state/round={done}")
    keyed = F.col("_k").cast(kind).alias(key)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(max(done, 1) - 1)), lambda i: F.struct(
        i.cast("int").alias("round"), F.get("losses", 2 * i).alias("train_loss"),
        F.nanvl(F.get("losses", 2 * i + 1), F.lit(None).cast("double")).alias("valid_loss")))
    told = state.select(keyed, F.inline(pairs)) if done else state.select(
        keyed, F.lit(0).alias("round"), F.lit(0.0).alias("train_loss"), F.lit(0.0).alias("valid_loss")).limit(0)
    return state.select(keyed, "coef", F.col("n").alias("n_train")), told
