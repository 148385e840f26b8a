"""Time-series window features per symbol.

All functions share ``Window.partitionBy(key).orderBy(order)`` so that Spark
plans a single exchange + sort for a chain of them. Inputs are daily series
(one row per symbol and calendar day, i.e. bounded by the number of days, not
by the raw row count).

Recursive EMAs have no frame form. They are computed exactly to double
precision from a bounded trailing frame: the weight of an observation ``k``
rows back is at most ``(1 - a)^k``, so a frame of ``K`` valid observations with
``(1 - a)^K < 2^-60`` reproduces the full recursion. The frame is anchored on
the running count of valid observations (a RANGE frame), so null rows never
shrink it. Work is O(n * K) per symbol and never needs the whole series in
one array; ``ema_block_scan`` is the O(n) alternative.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.functions.numeric import present, safe_ln
from marketmood.session import store

KEY = "symbol"
ORDER = "date"
# Relative truncation error bound of the EMA frames.
EMA_EPS_LOG2 = 60


def _keys(key):
    return list(key) if isinstance(key, (list, tuple)) else [key]


def series_window(key=KEY, order: str = ORDER):
    return Window.partitionBy(*_keys(key)).orderBy(order)


def _frame(n: int, key=KEY, order=ORDER):
    return series_window(key, order).rowsBetween(-(n - 1), 0)


def moving_average(c: str, n: int, key=KEY, order=ORDER) -> Column:
    """Mean of the last ``n`` rows; NULL until ``n`` non-null values fill it."""
    f = _frame(n, key, order)
    return F.when(F.count(F.col(c)).over(f) == n, F.avg(c).over(f))


def moving_std(c: str, n: int, key=KEY, order=ORDER) -> Column:
    """Sample standard deviation of the last ``n`` rows, same gating as W1."""
    f = _frame(n, key, order)
    return F.when(F.count(F.col(c)).over(f) == n, F.stddev_samp(c).over(f))


def bollinger(df: DataFrame, c: str = "close", n: int = 20, k: float = 2.0,
              keep_std: bool = False, key=KEY, order=ORDER) -> DataFrame:
    """``upper_band``/``lower_band`` = MA(n) +/- k * std(n)."""
    ma, sd = moving_average(c, n, key, order), moving_std(c, n, key, order)
    out = df.withColumn("upper_band", ma + F.lit(k) * sd).withColumn("lower_band", ma - F.lit(k) * sd)
    if keep_std:
        out = out.withColumn(f"sd{n}", sd)
    return out


def _frame_len(q: float) -> int:
    return max(1, math.ceil(EMA_EPS_LOG2 * math.log(2.0) / -math.log(q)))


def ema_recursive(df: DataFrame, c: str, span: float | None = None, alpha: float | None = None,
                  out: str | None = None, key=KEY, order=ORDER) -> DataFrame:
    """``y0 = x0``, ``y_t = (1-a) y_{t-1} + a x_t`` (not adjusted), a = 2/(span+1).

    Nulls age the old weight: after ``g`` rows since the last value,
    ``y = (q^g y_prev + a x) / (q^g + a)``; null rows repeat the last value and
    leading nulls stay null.
    """
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    return ema_recursive_multi(df, c, [a], [out or f"ema_{c}"], key, order)


def ema_recursive_multi(df: DataFrame, c: str, alphas, outs, key=KEY, order=ORDER) -> DataFrame:
    """Several non-adjusted EMAs of one column; the preparation windows are
    shared, and each EMA folds its own frame sized for its decay (a shared
    frame sized for the slowest decay folds more elements than needed).
    """
    w = series_window(key, order)
    x = F.col(c)
    rn, vo, last_rn = "_ema_rn", "_ema_vo", "_ema_last"
    prep = (df.withColumn(rn, F.row_number().over(w))
            .withColumn(vo, F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn(last_rn, F.last(F.when(x.isNotNull(), F.col(rn)), ignorenulls=True)
                        .over(w.rowsBetween(Window.unboundedPreceding, -1))))
    g = (F.col(rn) - F.col(last_rn)).cast("double")

    def step(acc, e):
        return F.when(e["skip"], acc).otherwise(F.coalesce(acc * e["A"], F.lit(0.0)) + e["B"] * e["x"])

    for a, out in zip(alphas, outs):
        q = 1.0 - a
        qg = F.pow(F.lit(q), g)
        elem = F.struct(
            F.when(x.isNull(), F.lit(1.0)).when(F.col(last_rn).isNull(), F.lit(0.0))
            .otherwise(qg / (qg + F.lit(a))).alias("A"),
            F.when(x.isNull(), F.lit(0.0)).when(F.col(last_rn).isNull(), F.lit(1.0))
            .otherwise(F.lit(a) / (qg + F.lit(a))).alias("B"),
            F.coalesce(x, F.lit(0.0)).cast("double").alias("x"), x.isNull().alias("skip"))
        wv = Window.partitionBy(*_keys(key)).orderBy(vo).rangeBetween(-_frame_len(q), 0)
        folded = F.aggregate(F.collect_list(elem).over(wv), F.lit(None).cast("double"), step)
        prep = prep.withColumn(out, F.when(F.col(vo) > 0, folded))
    return prep.drop(rn, vo, last_rn)


def ema_adjusted(df: DataFrame, c: str, com: float | None = None, span: float | None = None,
                 out: str | None = None, key=KEY, order=ORDER) -> DataFrame:
    """Adjusted EMA = sum q^(t-j) x_j / sum q^(t-j) over valid j <= t.

    Distances count every row (nulls age the weights). Leading nulls stay null.
    """
    a = 1.0 / (1.0 + com) if com is not None else 2.0 / (span + 1.0)
    q = 1.0 - a
    out = out or f"ema_{c}"
    k = _frame_len(q)
    w = series_window(key, order)
    rn = "_ema_rn"
    elem = F.struct(F.col(rn).alias("r"), F.col(c).cast("double").alias("x"))
    lst = F.collect_list(elem).over(w.rowsBetween(-k, 0))
    def weight(e):
        return F.pow(F.lit(q), (F.col(rn) - e["r"]).cast("double"))

    def step(acc, e):
        some = e["x"].isNotNull()
        return F.struct((acc["num"] + F.when(some, weight(e) * e["x"]).otherwise(0.0)).alias("num"),
                        (acc["den"] + F.when(some, weight(e)).otherwise(0.0)).alias("den"))

    mean = F.aggregate(lst, F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den")), step,
                       lambda acc: F.when(acc["den"] > 0, acc["num"] / acc["den"]))
    return df.withColumn(rn, F.row_number().over(w)).withColumn(out, mean).drop(rn)


def macd(df: DataFrame, c: str = "close", fast: float = 12, slow: float = 26, out: str = "macd",
         key=KEY, order=ORDER, ema_method: str = "block") -> DataFrame:
    """EMA(fast) - EMA(slow), helpers dropped.

    ``ema_method``: ``"block"`` (default, :func:`ema_block_scan`, O(rows)) or
    ``"frame"`` (folds in the recursion's order, O(rows x frame)).
    """
    ema = ema_block_scan if ema_method == "block" else ema_recursive_multi
    d = ema(df, c, [2.0 / (fast + 1.0), 2.0 / (slow + 1.0)], ["_ema_fast", "_ema_slow"], key, order)
    return d.withColumn(out, F.col("_ema_fast") - F.col("_ema_slow")).drop("_ema_fast", "_ema_slow")


def log_return(c: str = "close", key=KEY, order=ORDER) -> Column:
    """ln(x_t / x_{t-1}); NULL where the ratio is not positive or undefined."""
    prev = F.lag(c, 1).over(series_window(key, order))
    ratio = F.try_divide(F.col(c), prev)
    return safe_ln(ratio)


def log_level(c: str = "close", offset: float = -1.0) -> Column:
    """ln(x + offset) (NULL for non-positive arguments)."""
    return safe_ln(F.col(c) + F.lit(offset))


def forward_fill(df: DataFrame, cols, key=KEY, order=ORDER) -> DataFrame:
    """Replace missing values (NULL, NaN) by the last present one; leading ones become or stay NULL."""
    f = series_window(key, order).rowsBetween(Window.unboundedPreceding, 0)
    cols = set(cols)
    return df.select(*[F.last(present(df, c), ignorenulls=True).over(f).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def with_position(df: DataFrame, out: str = "pos", key=KEY, order=ORDER) -> DataFrame:
    """1-based row number per series (BIGINT)."""
    return df.withColumn(out, F.row_number().over(series_window(key, order)).cast("bigint"))


def technical_indicators(df: DataFrame, c: str = "close", key=KEY, order=ORDER,
                         keep_std: bool = False, ema_method: str = "block") -> DataFrame:
    """The daily indicator block of the feature pipeline.

    Adds ``ma7, ma20, macd, upper_band, lower_band, ema, log_momentum``.
    """
    d = (df.withColumn("ma7", moving_average(c, 7, key, order))
         .withColumn("ma20", moving_average(c, 20, key, order)))
    d = macd(d, c, 12, 26, "macd", key, order, ema_method)
    d = bollinger(d, c, 20, 2.0, keep_std, key, order)
    d = ema_adjusted(d, c, com=0.5, out="ema", key=key, order=order)
    return d.withColumn("log_momentum", log_return(c, key, order))


def _null_safe_join(left: DataFrame, right: DataFrame, cols) -> DataFrame:
    """Inner join on equal or equally NULL columns; the right side's copies are dropped."""
    r = right.select(*[F.col(c).alias(f"_j_{c}") if c in cols else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in cols]
    return left.join(r, on).drop(*[f"_j_{c}" for c in cols])


def bucketed_windows(df: DataFrame, bucket: Column, lookback: int, compute, key: str = KEY,
                     order: str = ORDER, lookahead: int = 0, valid: Column | None = None) -> DataFrame:
    """Run trailing-frame window features per (key, time bucket) instead of per key.

    For series where one key holds a large share of all rows, a window
    partitioned by key alone runs in one task. Here each series is cut into
    buckets (e.g. ``F.year("date")``); every bucket also receives the
    ``lookback`` rows that precede it, so frames reaching at most ``lookback``
    rows back are exact. With ``valid``, only rows where it holds count as
    looked back over (those between them come along). Positions come from
    per-bucket counts (small), the overlap rows are found with an equi-join on
    positions, and the windows then run in parallel over ``(key, bucket)``. The
    positions are written to the shared folder once, as counts, frame and
    overlap all read them. NULL keys and order values form series and buckets
    of their own; no row is lost.

    ``lookahead`` rows after each bucket are added the same way for frames
    that look forward (sequence windows). ``compute(frame_df, w)`` adds columns
    using the window spec ``w`` (partition ``(key, _bucket)``, order ``_rn``,
    the global 1-based position); only each bucket's own rows are returned.
    """
    d = df.withColumn("_bucket", bucket).withColumn("_ok", F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    local = Window.partitionBy(key, "_bucket").orderBy(order)
    d = d.withColumn("_lrn", F.row_number().over(local))
    upto = Window.partitionBy(key, "_bucket").orderBy("_lrn").rowsBetween(Window.unboundedPreceding, 0)
    d = store(d.withColumn("_lvo", F.count(F.when(F.col("_ok"), 1)).over(upto)).drop("_ok"), "positions")
    counts = d.groupBy(key, "_bucket").agg(F.max("_lrn").cast("bigint").alias("_cnt"), F.max("_lvo").alias("_vcnt"))
    wb = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", "_cnt", F.coalesce(F.sum("_cnt").over(wb), F.lit(0)).alias("_off"),
                            F.coalesce(F.sum("_vcnt").over(wb), F.lit(0)).alias("_voff"))
    d = (_null_safe_join(d, offsets.select(key, "_bucket", "_off", "_voff"), [key, "_bucket"])
         .withColumn("_rn", F.col("_off") + F.col("_lrn")).withColumn("_vo", F.col("_voff") + F.col("_lvo"))
         .drop("_lrn", "_lvo", "_off", "_voff"))
    # Positions that a bucket needs from before its start (by the count of valid
    # rows) and after its end; positions past the series end match nothing.
    frames = [d.withColumn("_own", F.lit(True))]

    def overlap(need, at):
        found = _null_safe_join(d, need, [key, at])
        return (found.filter(F.col("_rn").between(F.col("_from"), F.col("_to"))).drop("_bucket", "_from", "_to")
                .withColumnRenamed("_target", "_bucket").withColumn("_own", F.lit(False)))

    target, off, end = F.col("_bucket").alias("_target"), F.col("_off"), F.col("_off") + F.col("_cnt")
    if lookback > 0:
        first = F.greatest(F.col("_voff") - lookback + 1, F.lit(1))
        frames.append(overlap(offsets.filter(F.col("_voff") > 0).select(
            key, target, F.lit(1).alias("_from"), off.alias("_to"),
            F.explode(F.sequence(first, F.col("_voff"))).alias("_vo")), "_vo"))
    if lookahead > 0:
        frames.append(overlap(offsets.select(
            key, target, (end + 1).alias("_from"), (end + lookahead).alias("_to"),
            F.explode(F.sequence(end + 1, end + lookahead)).alias("_rn")), "_rn"))
    frame = frames[0]
    for f in frames[1:]:
        frame = frame.unionByName(f)
    out = compute(frame.drop("_vo"), Window.partitionBy(key, "_bucket").orderBy("_rn"))
    return out.filter(F.col("_own")).drop("_own", "_bucket", "_rn")


def moving_features_bucketed(df: DataFrame, c: str = "close", bucket: Column | None = None,
                             key: str = KEY, order: str = ORDER) -> DataFrame:
    """W1/W3/W7 (MA7, MA20, Bollinger 20/2, log return) with the series split into
    time buckets (default: calendar year) for parallelism over hot keys."""
    bucket = bucket if bucket is not None else F.year(order)

    def compute(frame, w):
        def ma(n):
            f = w.rowsBetween(-(n - 1), 0)
            return F.when(F.count(F.col(c)).over(f) == n, F.avg(c).over(f))

        f20 = w.rowsBetween(-19, 0)
        sd20 = F.when(F.count(F.col(c)).over(f20) == 20, F.stddev_samp(c).over(f20))
        prev = F.lag(c, 1).over(w)
        return frame.select("*", ma(7).alias("ma7"), ma(20).alias("ma20"),
                            (ma(20) + F.lit(2.0) * sd20).alias("upper_band"),
                            (ma(20) - F.lit(2.0) * sd20).alias("lower_band"),
                            safe_ln(F.try_divide(F.col(c), prev)).alias("log_return"))

    return bucketed_windows(df, bucket, 19, compute, key, order)


def ema_adjusted_bucketed(df: DataFrame, c: str, com: float | None = None, span: float | None = None, out: str | None = None,
                          bucket: Column | None = None, key: str = KEY, order: str = ORDER) -> DataFrame:
    """W6 with the series split into time buckets (default: calendar year)."""
    a = 1.0 / (1.0 + com) if com is not None else 2.0 / (span + 1.0)

    def compute(frame, w):
        return ema_adjusted(frame, c, com, span, out, key=[key, "_bucket"], order="_rn")

    return bucketed_windows(df, F.year(order) if bucket is None else bucket, _frame_len(1.0 - a) + 1, compute, key, order)


def technical_indicators_bucketed(df: DataFrame, c: str = "close", bucket: Column | None = None, key: str = KEY,
                                  order: str = ORDER, keep_std: bool = False) -> DataFrame:
    """:func:`technical_indicators` with the series split into time buckets (default: calendar year).

    Every bucket gets as many preceding values as the slowest EMA needs, so a
    bucket should hold some thousand rows; use it for long intraday series.
    """
    def compute(frame, w):
        return technical_indicators(frame, c, [key, "_bucket"], "_rn", keep_std, ema_method="frame")

    lookback = ema_frame_rows([2.0 / 13.0, 2.0 / 27.0]) + 20
    return bucketed_windows(df, F.year(order) if bucket is None else bucket, lookback, compute, key, order,
                            valid=F.col(c).isNotNull())


def ema_frame_rows(alphas) -> int:
    """Rows of history an exact (2^-60) non-adjusted EMA needs."""
    return max(_frame_len(1.0 - a) for a in alphas)


def ema_bucketed(df: DataFrame, c: str, alphas, outs, bucket: Column | None = None,
                 key: str = KEY, order: str = ORDER) -> DataFrame:
    """W4 with the series split into time buckets (default: calendar year).

    Each bucket receives the EMA frame length of preceding non-null values and
    the rows between them, so the values equal :func:`ema_recursive_multi`.
    """
    bucket = bucket if bucket is not None else F.year(order)

    def compute(frame, w):
        return ema_recursive_multi(frame, c, alphas, outs, key=[key, "_bucket"], order="_rn")

    return bucketed_windows(df, bucket, ema_frame_rows(alphas) + 1, compute, key, order, valid=F.col(c).isNotNull())


# Block size (valid values) of the EMA block scan and the floor of one step's
# log-decay (a weight below e^-40 ~ 4e-18 is an exact reset in double precision).
EMA_BLOCK = 16
EMA_LN_MIN = -40.0


def ema_block_scan(df: DataFrame, c: str, alphas, outs, key=KEY, order=ORDER) -> DataFrame:
    """Non-adjusted EMAs in O(rows): the alternative to :func:`ema_recursive_multi`
    for very long series.

    Each valid row is an affine step ``y = A y_prev + B x``. Rows are grouped in
    blocks of ``EMA_BLOCK`` valid values; inside a block the recursion is a
    running (incremental) window sum in rebased log space, and the carry into a
    block folds the block-level recursion ``Y_b = e^{T_b} Y_{b-1} + L_b`` over
    the last block ends (enough of them for a 2^-60 truncation). Exponents stay
    within one block. The result equals the row recursion to ~1e-15 relative
    but associates the arithmetic differently, so the last printed digit of a
    6-decimal report can differ, so reports compare fewer decimals.
    """
    keys = _keys(key)
    qs = [1.0 - a for a in alphas]
    n_blocks = math.ceil(max(_frame_len(q) for q in qs) / EMA_BLOCK) + 1
    w = Window.partitionBy(*keys).orderBy(order)
    x = F.col(c)
    d = (df.withColumn("_eb_rn", F.row_number().over(w))
         .withColumn("_eb_vo", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_eb_last", F.last(F.when(x.isNotNull(), F.col("_eb_rn")), ignorenulls=True)
                     .over(w.rowsBetween(Window.unboundedPreceding, -1))))
    started = F.col("_eb_last").isNotNull()
    g = (F.col("_eb_rn") - F.col("_eb_last")).cast("double")
    d = d.withColumn("_eb_blk", F.when(F.col("_eb_vo") > 0, F.floor((F.col("_eb_vo") - 1) / EMA_BLOCK)))
    wb = Window.partitionBy(*keys, "_eb_blk").orderBy("_eb_rn").rowsBetween(Window.unboundedPreceding, 0)
    steps = []
    for a, q in zip(alphas, qs):
        qg = F.pow(F.lit(q), g)
        lna = F.when(x.isNull() | ~started, F.lit(0.0)).otherwise(
            F.greatest(F.log(qg / (qg + F.lit(a))), F.lit(EMA_LN_MIN)))
        b = F.when(x.isNull(), F.lit(0.0)).when(~started, F.lit(1.0)).otherwise(F.lit(a) / (qg + F.lit(a)))
        steps.append((lna, b * F.coalesce(x, F.lit(0.0))))
    d = d.select("*", *[lna.alias(f"_eb_lna{i}") for i, (lna, _) in enumerate(steps)],
                 *[bx.alias(f"_eb_bx{i}") for i, (_, bx) in enumerate(steps)])
    d = d.select("*", *[F.sum(f"_eb_lna{i}").over(wb).alias(f"_eb_lam{i}") for i in range(len(alphas))])
    d = d.select("*", *[(F.exp(F.col(f"_eb_lam{i}"))
                         * F.sum(F.exp(-F.col(f"_eb_lam{i}")) * F.col(f"_eb_bx{i}")).over(wb)).alias(f"_eb_loc{i}")
                        for i in range(len(alphas))])
    is_end = F.col("_eb_blk").isNotNull() & F.coalesce(F.lead("_eb_blk").over(w) != F.col("_eb_blk"), F.lit(True))
    d = d.withColumn("_eb_end", is_end)
    wc = Window.partitionBy(*keys).orderBy("_eb_blk").rangeBetween(-n_blocks, -1)

    def carry(i):
        ends = F.collect_list(F.when(F.col("_eb_end"), F.struct(F.col(f"_eb_lam{i}").alias("t"),
                                                                 F.col(f"_eb_loc{i}").alias("l")))).over(wc)
        return F.aggregate(ends, F.lit(0.0), lambda acc, e: acc * F.exp(e["t"]) + e["l"])

    d = d.select("*", *[F.when(F.col("_eb_blk").isNotNull(),
                               F.col(f"_eb_loc{i}") + F.exp(F.col(f"_eb_lam{i}")) * carry(i)).alias(out)
                        for i, out in enumerate(outs)])
    return d.drop(*[col for col in d.columns if col.startswith("_eb_")])
