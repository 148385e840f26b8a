"""Forecast and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.functions.text import LABEL_NAMES


def mean_by_target_date(pred: DataFrame, value: str = "pred", dates: str = "y_dates",
                        keys=("symbol",), out: str | None = None) -> DataFrame:
    """Average of overlapping window predictions per target date.

    ``value`` and ``dates`` are equally long arrays (one entry per horizon
    step); they are zipped, exploded and averaged per ``(keys..., date)``.
    """
    out = out or f"{value}_mean"
    z = pred.select(*keys, F.explode(F.arrays_zip(F.col(dates).alias("d"), F.col(value).alias("v"))).alias("z"))
    return z.groupBy(*keys, F.col("z.d").alias("date")).agg(F.avg("z.v").alias(out))


def rmse(df: DataFrame, pred: str = "predicted", real: str = "real", by=("symbol",)) -> DataFrame:
    """sqrt(mean((pred - real)^2)) per group."""
    d = F.col(pred) - F.col(real)
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n"))


def nrmse(df: DataFrame, pred: str = "predicted", real: str = "real", by=("symbol",)) -> DataFrame:
    """RMSE / mean(real); NULL when the mean is 0."""
    d = F.col(pred) - F.col(real)
    return df.groupBy(*by).agg(
        F.try_divide(F.sqrt(F.avg(d * d)), F.avg(real)).alias("nrmse"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          classes=(0, 1, 2), names=LABEL_NAMES) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages.

    One confusion-count aggregation (at most classes^2 rows) feeds the report;
    0/0 is reported as 0.
    """
    conf = df.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    per = []
    for k, name in zip(classes, names):
        tp = F.sum(F.when((F.col("t") == k) & (F.col("p") == k), F.col("c")).otherwise(0))
        sup = F.sum(F.when(F.col("t") == k, F.col("c")).otherwise(0))
        npred = F.sum(F.when(F.col("p") == k, F.col("c")).otherwise(0))
        per += [tp.alias(f"tp{k}"), sup.alias(f"sup{k}"), npred.alias(f"np{k}")]
    tot = conf.agg(*per, F.sum("c").alias("n"),
                   F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)).alias("ok"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    # Everything below is derived from the single row ``tot`` in one projection,
    # so the (possibly expensive) input is aggregated exactly once.
    n = F.col("n")
    prec = {k: ratio(F.col(f"tp{k}"), F.col(f"np{k}")) for k in classes}
    rec = {k: ratio(F.col(f"tp{k}"), F.col(f"sup{k}")) for k in classes}
    f1 = {k: ratio(2 * prec[k] * rec[k], prec[k] + rec[k]) for k in classes}
    sup = {k: F.col(f"sup{k}") for k in classes}

    def mean(d):
        out = F.lit(0.0)
        for k in classes:
            out = out + d[k]
        return out / F.lit(float(len(classes)))

    def weighted(d):
        out = F.lit(0.0)
        for k in classes:
            out = out + d[k] * sup[k]
        return ratio(out, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("bigint").alias("support"))

    acc = ratio(F.col("ok"), n)
    rows = [row(name, prec[k], rec[k], f1[k], sup[k]) for k, name in zip(classes, names)]
    rows += [row("accuracy", acc, acc, acc, n),
             row("macro avg", mean(prec), mean(rec), mean(f1), n),
             row("weighted avg", weighted(prec), weighted(rec), weighted(f1), n)]
    return tot.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def persistence_forecast(seq: DataFrame, horizon: int = 1) -> DataFrame:
    """M7: predict the last observed target value for every horizon step."""
    return seq.withColumn("pred", F.array_repeat(F.element_at("yc", -1), horizon))


def evaluate_forecast(pred: DataFrame, keys=("symbol", "split")) -> DataFrame:
    """Average overlapping predictions and real values per target date, pair
    them by date and report RMSE per ``keys``.

    ``pred`` carries ``y`` (real), ``pred`` (predicted) and ``y_dates`` arrays
    in price units. Both averages come from one explode and one aggregation
    (they share the target dates), so the input is read once.
    """
    z = pred.select(*keys, F.explode(F.arrays_zip(F.col("y_dates").alias("d"), F.col("pred").alias("p"),
                                                  F.col("y").alias("r"))).alias("z"))
    by_date = z.groupBy(*keys, F.col("z.d").alias("date")).agg(
        F.avg("z.p").alias("predicted"), F.avg("z.r").alias("real"))
    return rmse(by_date, "predicted", "real", by=keys)
