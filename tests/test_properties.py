"""Randomised checks against small brute-force implementations."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import col_values, series_df
from marketmood.operators import indicators as ind

values = st.lists(st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False)),
                  min_size=1, max_size=60)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ema_brute(xs, a):
    q, y, g, out = 1.0 - a, None, 0, []
    for v in xs:
        g += 1
        if v is not None:
            if y is None:
                y = v
            else:
                w = q ** g
                y = (w * y + a * v) / (w + a)
            g = 0
        out.append(y)
    return out


def ma_brute(xs, n):
    out = []
    for i in range(len(xs)):
        win = xs[max(0, i - n + 1):i + 1]
        vals = [v for v in win if v is not None]
        out.append(sum(vals) / n if len(win) == n and len(vals) == n else None)
    return out


def close(a, b, tol=1e-9):
    return len(a) == len(b) and all((x is None and y is None) or
                                    (x is not None and y is not None and abs(x - y) <= tol * (1 + abs(y)))
                                    for x, y in zip(a, b))


@SETTINGS
@given(xs=values, span=st.sampled_from([2, 3, 12]))
def test_ema_matches_brute_force(spark, xs, span):
    a = 2.0 / (span + 1.0)
    df = series_df(spark, xs)
    got = col_values(ind.ema_recursive(df, "x", span=span, out="e"), "e")
    assert close(got, ema_brute(xs, a))
    blk = col_values(ind.ema_block_scan(df, "x", [a], ["e"]), "e")
    assert close(blk, ema_brute(xs, a), 1e-8)


@SETTINGS
@given(xs=values, n=st.sampled_from([1, 3, 7]))
def test_moving_average_matches_brute_force(spark, xs, n):
    df = series_df(spark, xs)
    got = col_values(df.withColumn("m", ind.moving_average("x", n)), "m")
    assert close(got, ma_brute(xs, n))


@SETTINGS
@given(xs=st.lists(st.floats(min_value=0.5, max_value=1e3, allow_nan=False), min_size=2, max_size=40))
def test_log_return_matches_brute_force(spark, xs):
    df = series_df(spark, xs)
    got = col_values(df.withColumn("r", ind.log_return("x")), "r")
    exp = [None] + [math.log(xs[i] / xs[i - 1]) for i in range(1, len(xs))]
    assert close(got, exp)


# ---------------------------------------------------------------- sentiment rules
from marketmood.operators import sentiment as S  # noqa: E402
from marketmood.sources import fixtures as FX  # noqa: E402

LEX = dict(FX.DEMO_LEXICON)
WORDS = ["best", "trash", "idiot", "stock", "price", "the", "no", "not", "never", "don't", "very",
         "slightly", "but", "least", "at", "kind", "of", "ok"]


def _variants(w):
    return st.sampled_from([w, w.upper(), w.capitalize()])


token = st.tuples(st.sampled_from(WORDS).flatmap(_variants),
                  st.sampled_from(["", "!", "?", "!!", "??", "...", ",", "?!?"]))
texts = st.lists(token, min_size=0, max_size=12).flatmap(
    lambda toks: st.lists(st.sampled_from([" ", "  ", "\n", "\t"]), min_size=len(toks), max_size=len(toks))
    .map(lambda seps: "".join(w + p + sep for (w, p), sep in zip(toks, seps))))


def score_brute(text):
    import re
    toks = [t for t in re.split(r"[\t\n\x0b\f\r ]+", text) if t]
    toks = [t.strip(S.PUNCT_CHARS) if len(t.strip(S.PUNCT_CHARS)) > 2 else t for t in toks]
    n = len(toks)
    if n == 0:
        return 0.0

    def isup(t):
        return t.upper() == t and t.lower() != t

    ncaps = sum(isup(t) for t in toks)
    capdiff = 0 < ncaps < n
    lt = [t.lower() for t in toks]
    bi = lt.index("but") if "but" in lt else -1
    sent = []
    for i, t in enumerate(toks):
        low = lt[i]
        if low not in LEX or low in S.BOOSTERS or (low == "kind" and i + 1 < n and lt[i + 1] == "of"):
            sent.append(0.0)
            continue
        v = LEX[low]
        if isup(t) and capdiff:
            v = v + S.C_INCR if v > 0 else v - S.C_INCR
        for d in (1, 2, 3):
            if i - d < 0 or lt[i - d] in LEX:
                continue
            p, lp = toks[i - d], lt[i - d]
            b = S.BOOSTERS.get(lp, 0.0)
            s = 0.0
            if b != 0:
                s = -b if v < 0 else b
                if isup(p) and capdiff:
                    s += S.C_INCR if v > 0 else -S.C_INCR
            v = v + s * S.DISTANCE_DAMPING[d - 1]
            if lp in S.NEGATIONS or "n't" in lp:
                v *= S.N_SCALAR
        if i >= 1 and lt[i - 1] == "least" and lt[i - 1] not in LEX and (i < 2 or lt[i - 2] not in ("at", "very")):
            v *= S.N_SCALAR
        if bi >= 0:
            v *= S.BUT_BEFORE if i < bi else (S.BUT_AFTER if i > bi else 1.0)
        sent.append(v)
    amp = min(text.count("!"), 4) * S.EXCL_STEP
    qm = text.count("?")
    amp += S.QM_MAX if qm > 3 else (qm * S.QM_STEP if qm > 1 else 0.0)
    s = sum(sent)
    s = s + amp if s > 0 else (s - amp if s < 0 else s)
    comp = max(-1.0, min(1.0, s / math.sqrt(s * s + S.ALPHA)))
    return math.floor(comp * 10000.0 + 0.5) / 10000.0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(texts, min_size=1, max_size=8))
def test_compound_matches_rule_brute_force(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string")
    got = {r.doc_id: r.compound for r in S.score_sentiment(df, lex=FX.lexicon(spark)).collect()}
    for i, t in enumerate(batch):
        assert abs(got[i] - score_brute(t)) <= 1e-4 + 1e-12, (t, got[i], score_brute(t))


# ---------------------------------------------------------------- splits and buckets
@SETTINGS
@given(n=st.integers(min_value=1, max_value=400), frac=st.sampled_from([0.1, 0.2, 0.5, 0.9]))
def test_hash_split_exact_fraction(spark, n, frac):
    from marketmood.operators.sequences import hash_split
    df = spark.range(0, n).withColumnRenamed("id", "k")
    out = hash_split(df, "k", frac, 7)
    assert out.count() == n
    assert out.filter("split = 'test'").count() == math.ceil(n * frac)


@SETTINGS
@given(xs=st.lists(st.floats(min_value=1.0, max_value=100.0, allow_nan=False), min_size=1, max_size=80),
       width=st.integers(min_value=1, max_value=30))
def test_bucketed_windows_equal_unbucketed(spark, xs, width):
    from pyspark.sql import functions as F
    df = series_df(spark, xs).withColumnRenamed("x", "close")
    bucket = F.floor(F.datediff("date", F.lit("2020-01-01")) / width)
    got = col_values(ind.moving_features_bucketed(df, "close", bucket), "ma20")
    exp = col_values(df.withColumn("ma20", ind.moving_average("close", 20)), "ma20")
    assert close(got, exp)
