"""Model training and batch inference.

* Text classifier: an MLlib pipeline (regex tokens -> stop words -> hashed TF
  -> IDF -> multinomial logistic regression), trained and applied on whole
  tables.
* Price forecaster: one ridge regression per symbol on the flattened input
  window. The normal equations are built from sufficient statistics (``X'X``,
  ``X'y`` per symbol): one numpy product per Arrow batch, summed on the cluster
  by ``Summarizer``; only the p x p system per symbol (p = window x features + 1,
  independent of the row count) is solved in a pandas task. Coefficients are
  a small table joined back by symbol for inference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketmood.functions.text import STOP_WORDS, decode_label
from marketmood.session import store


# ---------------------------------------------------------------- classifier
def fit_sentiment_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                             num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01) -> PipelineModel:
    """M2: 3-class text classifier (Spark ML pipeline).

    The texts are read once: their term counts are written to the shared folder,
    and IDF and regression are fitted on those. ``_tree_shape`` deals the counts
    so that one gradient an evaluation reaches the driver, whatever their size.
    """
    counting = PipelineModel(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern="[\\p{L}\\p{N}_]+", gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(STOP_WORDS)),
        HashingTF(inputCol="_kept", outputCol="_tf", numFeatures=num_features),
    ])
    train = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = store(counting.transform(train).select(label_col, "_tf"), "term-counts")
    parts, depth = _tree_shape(counts.rdd.getNumPartitions())
    counts = counts.repartition(parts)
    idf = IDF(inputCol="_tf", outputCol="_features").fit(counts)
    regression = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial",
                                    maxIter=max_iter, regParam=reg, aggregationDepth=depth)
    return PipelineModel(stages=[*counting.stages, idf, regression.fit(idf.transform(counts))])


def _tree_shape(splits: int) -> tuple[int, int]:
    """Partitions and ``aggregationDepth`` of a fit on a table of ``splits`` splits.

    Gradients are summed four to one in ``depth`` levels. 28 partitions are 28,
    7, 1 and 112 are 112, 28, 7, 1: the last sum is made on the cluster, and the
    driver gets one vector of features x classes. Other counts leave it three to
    dozens of them.
    """
    parts, depth = 28, 3
    while parts * 4 < splits:
        parts, depth = parts * 4, depth + 1
    return parts, depth


def predict_sentiment(df: DataFrame, model: PipelineModel, keep=("doc_id",)) -> DataFrame:
    """M3: batch inference: ``(keep..., prediction, label_name, p_negative, p_neutral, p_positive)``."""
    out = model.transform(df.fillna({model.stages[0].getInputCol(): ""}))
    probs = vector_to_array("probability")
    return out.select(*keep, F.col("prediction").cast("bigint").alias("prediction"),
                      decode_label(F.col("prediction").cast("bigint")).alias("label_name"),
                      *[F.element_at(probs, i + 1).alias(n) for i, n in
                        enumerate(("p_negative", "p_neutral", "p_positive"))])


def training_history(model: PipelineModel, name: str = "sentiment") -> DataFrame:
    """M8: ``(model, iteration, objective)`` of the logistic-regression fit.

    A model that was loaded from a folder has no history: the table is empty.
    """
    lr = model.stages[-1]
    hist = list(lr.summary.objectiveHistory) if lr.hasSummary else []
    spark = SparkSession.active()
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(hist)],
                                 "model string, iteration int, objective double")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a pipeline model (MLlib format)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a pipeline model."""
    return PipelineModel.load(path)


# ---------------------------------------------------------------- forecaster (M5, M6)
def design_vector(x_col: str = "x"):
    """Flattened input window with a leading 1 (intercept)."""
    return F.concat(F.array(F.lit(1.0)), F.flatten(F.col(x_col)))


def window_sums(seq: DataFrame, key: str = "symbol", part: Column | None = None) -> DataFrame:
    """``(_k, part, xx, n)``: sums of products of [1, window, target] by key (as text) and part, and their row counts.

    Rows with a NULL in the window or target are left out. One numpy product
    per Arrow batch and key, summed on the cluster.
    """
    d = seq.filter(~F.exists(F.flatten("x"), lambda v: v.isNull()) & F.col("y")[0].isNotNull())
    d = d.select(F.col(key).cast("string").alias("_k"), (F.lit(True) if part is None else part).alias("part"),
                 design_vector("x").alias("_v"), F.col("y")[0].alias("_y"))

    def partial(batches):
        for pdf in batches:
            for (k, p), g in pdf.groupby(["_k", "part"], dropna=False):
                m = np.column_stack([np.stack(g["_v"].to_numpy()), g["_y"].to_numpy(dtype=float)])
                yield pd.DataFrame({"_k": [k if isinstance(k, str) else None], "part": [bool(p)],
                                    "xx": [(m.T @ m).ravel().tolist()], "n": [len(g)]})

    sums = (d.mapInPandas(partial, "_k string, part boolean, xx array<double>, n bigint")
            .groupBy("_k", "part").agg(Summarizer.sum(array_to_vector("xx")).alias("_xx"), F.sum("n").alias("n")))
    return sums.select("_k", "part", vector_to_array("_xx").alias("xx"), "n")


def fit_forecaster(seq: DataFrame, key: str = "symbol", ridge: float = 1e-3, split: str | None = "split",
                   train_value: str = "train") -> DataFrame:
    """M5: per-symbol ridge regression of the next target on the flattened window.

    Returns ``(symbol, coef array<double>, n_train)``; the key keeps its type,
    and rows without a key are a series of their own. Sufficient statistics are
    summed per symbol on the cluster; the solve runs once per symbol on a
    p x p matrix.
    """
    kind = seq.schema[key].dataType
    stats = window_sums(seq.filter(F.col(split) == train_value) if split else seq, key).drop("part")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            full = np.asarray(r["xx"], dtype=float)
            m = int(round(full.size ** 0.5)) - 1
            full = full.reshape(m + 1, m + 1)
            a, b = full[:m, :m], full[:m, m]
            reg = ridge * np.eye(m)
            reg[0, 0] = 0.0  # intercept not penalised
            coef = np.linalg.lstsq(a + reg, b, rcond=None)[0]
            rows.append((r["_k"], coef.tolist(), int(r["n"])))
        return pd.DataFrame(rows, columns=["_k", "coef", "n_train"])

    found = stats.groupBy("_k").applyInPandas(solve, "_k string, coef array<double>, n_train bigint")
    return found.select(F.col("_k").cast(kind).alias(key), "coef", "n_train")


def forecast(seq: DataFrame, coefs: DataFrame, key: str = "symbol", out: str = "pred") -> DataFrame:
    """M6: dot product of each window with its symbol's coefficients (JVM side)."""
    c = coefs.select(F.col(key).alias("_ck"), F.col("coef").alias("_coef"))
    d = seq.join(c, F.col(key).eqNullSafe(F.col("_ck"))).drop("_ck").withColumn("_v", design_vector("x"))
    dot = F.aggregate(F.zip_with("_v", "_coef", lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
    return d.withColumn(out, F.array(dot)).drop("_coef", "_v")
