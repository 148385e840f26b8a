"""Aggregations.

All are ``groupBy`` plans with map-side partial aggregation, so the shuffle
carries one row per key and task. Exact percentiles (A8) are bracketed by a
sketch and narrowed by counts, so no task holds a column's values.
"""

from __future__ import annotations

import bisect
import itertools
import sys

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketmood.functions.dates import day_of
from marketmood.functions.numeric import present


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """names of numeric columns (schema inspection, no data read)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def daily_mean(df: DataFrame, ts_col: str = "ts", key: str = "symbol", cols=None,
               exclude=()) -> DataFrame:
    """A1: per (symbol, calendar day) mean of every numeric column."""
    d = df.withColumn("date", day_of(df, ts_col)) if ts_col != "date" else df
    cols = cols or numeric_columns(d, exclude=set(exclude) | {key})
    return d.groupBy(key, "date").agg(*[F.avg(c).alias(c) for c in cols])


def sentiment_by_day(df: DataFrame, ts_col: str = "ts", score: str = "compound") -> DataFrame:
    """A2: mean score per calendar day over all symbols."""
    return df.groupBy(day_of(df, ts_col).alias("date")).agg(F.avg(score).alias(f"avg_{score}"))


def sentiment_by_symbol(df: DataFrame, score: str = "compound", key: str = "symbol") -> DataFrame:
    """A3: mean score per symbol."""
    return df.groupBy(key).agg(F.avg(score).alias(f"avg_{score}"))


def posts_per_day(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A4: number of posts per calendar day."""
    return df.groupBy(day_of(df, ts_col).alias("date")).agg(F.count(F.lit(1)).alias("n_posts"))


def volume_by_day(df: DataFrame, volume: str = "volume") -> DataFrame:
    """A5: total volume per day over all symbols."""
    return df.groupBy("date").agg(F.sum(volume).cast("bigint").alias("total_volume"))


def null_counts(df: DataFrame, cols) -> DataFrame:
    """``(column, nulls)``; NaN counts as missing for floating columns."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    aggs = []
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        aggs.append(F.count_if(miss).cast("bigint").alias(c))
    wide = df.agg(*aggs)
    return wide.unpivot([], list(cols), "column", "nulls")


def _regions(d: DataFrame, spans, bins: int) -> list[list[Row]]:
    """For each span ``(column, lo, hi, exact)`` the rows below lo, in it and above hi, in rising order.

    What lies inside is counted by value (``exact``) or by bins of equal width.
    Counts combine before the shuffle, so a task gets a row for each region and task.
    """
    items = []
    for i, (c, lo, hi, exact) in enumerate(spans):
        x, width = f"`{c}`", hi / bins - lo / bins
        key = x if exact else f"CAST(least(floor(({x} - {lo!r}D) / {width!r}D), {bins - 1}) AS DOUBLE)"
        side = f"CASE WHEN {x} < {lo!r}D THEN -1 WHEN {x} > {hi!r}D THEN 1 ELSE 0 END"
        items.append(f"CASE WHEN {x} IS NOT NULL THEN struct({i} AS slot, {side} AS side, "
                     f"CASE WHEN {x} BETWEEN {lo!r}D AND {hi!r}D THEN {key} END AS key, {x} AS x) END")
    each = d.selectExpr(f"explode(array({', '.join(items)})) AS s").filter("s IS NOT NULL").select("s.*")
    rows = each.groupBy("slot", "side", "key").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = [[] for _ in spans]
    for r in sorted(rows.collect(), key=lambda r: r["lo"]):
        out[r["slot"]].append(r)
    return out


def exact_quantiles(df: DataFrame, cols, probs, accuracy: int = 10_000, also=(), most: int = 10_000,
                    bins: int = 256) -> tuple[dict[str, list], Row]:
    """Interpolated exact quantiles of numeric columns (NaN is missing), without gathering a column's values anywhere.

    A sketch brackets each rank between two values. A pass counts the rows
    below, inside (by bins) and above each bracket and leaves the one region
    that holds the rank, until no more than ``most`` rows are left in it; these
    are counted by value. ``df`` is read twice, and once more for every 256th
    part of a bracket that still is too large; what reaches the driver is at
    most ``most`` values and ``bins`` counts a quantile. A column without values
    gives NULLs. Returns the quantiles by column, and a row with the aggregates
    in ``also``, which ride on the first pass.
    """
    d = df.select(*[present(df, c).cast("double").alias(c) for c in cols])
    delta = 2.0 / accuracy
    ends = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-delta, delta)]
    first = d.agg(*[F.count(c).alias(f"{c}__n") for c in cols],
                  *[F.percentile_approx(c, ends, accuracy).alias(f"{c}__e") for c in cols], *also).first()
    out = {c: [None] * len(probs) for c in cols}
    todo = {(c, i): (first[f"{c}__e"][2 * i], first[f"{c}__e"][2 * i + 1], 3 * delta * first[f"{c}__n"] <= most)
            for c in cols if first[f"{c}__n"] for i in range(len(probs))}
    while todo:
        keys, spans = list(todo), []
        for (c, _), (lo, hi, exact) in todo.items():
            lo, hi = (min(max(v, -sys.float_info.max), sys.float_info.max) for v in (lo, hi))
            spans.append((c, lo, hi, exact or hi / bins - lo / bins <= 0))
        for (c, i), regions in zip(keys, _regions(d, spans, bins)):
            rank = probs[i] * (first[f"{c}__n"] - 1)
            ends_at = list(itertools.accumulate(r["n"] for r in regions))
            low, high = (regions[bisect.bisect_right(ends_at, min(int(rank) + k, ends_at[-1] - 1))] for k in (0, 1))
            if low is high and low["lo"] < low["hi"]:
                todo[c, i] = low["lo"], low["hi"], low["n"] <= most
                continue
            del todo[c, i]
            a, b = (low["lo"], low["lo"]) if low is high else (low["hi"], high["lo"])
            out[c][i] = a if a == b or rank == int(rank) else a + (b - a) * (rank - int(rank))
    return out, first


def describe_numeric(df: DataFrame, cols, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 %, max, as rows ``(column, stat...)``; NaN is missing, as in pandas.

    ``exact=True`` gives interpolated exact quartiles (as pandas) by
    :func:`exact_quantiles`, which runs its aggregations right away;
    ``exact=False`` uses the ``percentile_approx`` sketch in the one pass that
    the other statistics take. Either way the result is a local table.
    """
    probs = [0.25, 0.5, 0.75]
    stats = {c: [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)] for c in cols}
    stats = [x.alias(f"{c}__{i}") for c in cols for i, x in enumerate(stats[c])]
    if exact:
        found, row = exact_quantiles(df, cols, probs, also=stats)
    else:
        d = df.select(*[present(df, c).cast("double").alias(c) for c in cols])
        row = d.agg(*stats, *[F.percentile_approx(c, probs, accuracy).alias(f"{c}__q") for c in cols]).first()
        found = {c: row[f"{c}__q"] or [None] * 3 for c in cols}
    rows = [(c, *[row[f"{c}__{i}"] for i in range(4)], *found[c], row[f"{c}__4"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def histogram(df: DataFrame, c: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width histogram ``([by,] bin, lo, hi, n)``.

    Bounds come from a global min/max (a scalar subquery); the last bin is
    closed on the right. NULL and NaN are missing. Only non-empty bins are
    returned.
    """
    x = present(df, c).cast("double")
    # global bounds as one scalar subquery (a single aggregate row, evaluated once)
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    d = df.filter(x.isNotNull())
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("bigint")
    keys = ([by] if by else []) + ["bin"]
    g = d.withColumn("bin", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, (lo + F.col("bin") * width).alias("lo"),
                    (lo + (F.col("bin") + 1) * width).alias("hi"), "n")


def symbol_list(df: DataFrame, key: str = "symbol", order: str = "date", limit: int | None = 6) -> DataFrame:
    """Distinct symbols in first-seen order (earliest ``order`` value, then name)."""
    g = df.groupBy(key).agg(F.min(order).alias("first_seen"))
    g = g.orderBy("first_seen", key)
    return g.limit(limit) if limit else g


def date_bounds(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Min / max date per symbol."""
    return df.groupBy(key).agg(F.min(order).alias("min_date"), F.max(order).alias("max_date"))


def series_length(df: DataFrame, key: str = "symbol", min_rows: int | None = None) -> DataFrame:
    """Rows per symbol, optionally only symbols with at least ``min_rows``."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.filter(F.col("n_rows") >= min_rows) if min_rows else g
