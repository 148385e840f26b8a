import math

import pytest
from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.operators.sentiment import score_sentiment
from marketmood.sources import fixtures as FX


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expr(F.col("t")).alias("o")).collect()[0].o


def test_url_strip(spark):
    assert one(spark, "see http://a.b/c?d HTTP://X now", TX.strip_urls) == "see  HTTP://X now"


def test_symbol_strip(spark):
    assert one(spark, "café_x! é", lambda c: F.regexp_replace(c, TX.NON_WORD_PATTERN, "")) == "café_x é"
    # inside the cleaning step the emptied token keeps its slot
    assert one(spark, "café_x! é", TX.clean_text) == "café_x  é"


def test_clean_text_drops_stopwords_keeps_emptied(spark):
    assert one(spark, "The cat, and the HAT!", TX.clean_text) == "cat  hat "


def test_length_code_points(spark):
    assert one(spark, "a\U0001F600b", TX.text_length) == 3


def test_sign_category(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.1,), (None,), (float("nan"),)], "c double")
    got = [r[0] for r in df.select(TX.sign_category("c")).collect()]
    assert got == ["Negative", "Neutral", "Positive", "Neutral", "Neutral"]


def test_threshold_label_and_decode(spark):
    df = spark.createDataFrame([(-1.0,), (0.4,), (0.41,), (0.6,), (0.61,), (None,)], "c double")
    got = [r[0] for r in df.select(TX.threshold_label("c")).collect()]
    assert got == [0, 0, 1, 1, 2, None]
    got2 = [r[0] for r in df.select(TX.threshold_label("c", null_as=2)).collect()]
    assert got2[-1] == 2
    names = [r[0] for r in df.select(TX.decode_label(TX.threshold_label("c"))).collect()]
    assert names == ["Negative", "Negative", "Neutral", "Neutral", "Positive", None]


def test_nfkd(spark):
    assert one(spark, "ﬁ", TX.nfkd) == "fi"
    assert one(spark, None, TX.nfkd) is None


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


def score(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return score_sentiment(df, "text", "doc_id", FX.lexicon(spark)).collect()[0]


@pytest.mark.parametrize("text,s", [
    ("best", 3.2),
    ("not best", 3.2 * -0.74),
    ("BEST stuff", 3.2 + 0.733),
    ("very best", 3.2 + 0.293),
    ("very nice best", 3.2 + 0.293 * 0.95),
    ("best but trash", 3.2 * 0.5 - 1.5 * 1.5),
    ("best!!", 3.2 + 2 * 0.292),
    ("trash??", -1.5 - 2 * 0.18),
    ("the idiot and the moron", -2.3 - 2.2),
    ("at least trash", -1.5),
    ("least trash", -1.5 * -0.74),
])
def test_compound_rules(spark, text, s):
    assert score(spark, text).compound == norm(s)


def test_shares(spark):
    r = score(spark, "not best")
    assert (r.neg, r.neu, r.pos) == (round(3.368 / 4.368, 3), round(1 / 4.368, 3), 0.0)
    r = score(spark, "best")
    assert (r.neg, r.neu, r.pos) == (0.0, 0.0, 1.0)


def test_empty_and_null(spark):
    r = score(spark, "")
    assert (r.neg, r.neu, r.pos, r.compound) == (0.0, 0.0, 0.0, 0.0)
    r = score(spark, None)
    assert r.compound is None and r.neu is None


def test_no_hits_is_neutral(spark):
    r = score(spark, "plain words here")
    assert (r.neu, r.compound) == (1.0, 0.0)


def test_scoring_is_partition_invariant(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = score_sentiment(docs, lex=FX.lexicon(spark)).orderBy("doc_id").collect()
    b = score_sentiment(docs.repartition(13), lex=FX.lexicon(spark)).orderBy("doc_id").collect()
    assert a == b and len(a) == docs.count()


def test_lexicon_of_any_size_and_join_gives_equal_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1, "NOT best but no idiot!! least trash, very BEST")], "doc_id long, text string")
    docs = docs.unionByName(extra.withColumn("doc_id", F.lit(10 ** 9)))
    a = score_sentiment(docs, lex=FX.lexicon(spark)).orderBy("doc_id").collect()
    many = FX.lexicon(spark).union(spark.range(60_000).select(F.concat(F.lit("absent"), "id"), F.lit(1.0)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = score_sentiment(docs, lex=many).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert a == b


def test_word_tables_equal_word_lists(spark):
    from marketmood.operators import sentiment as S
    rows = [(1, "NOT best but no idiot!! very least trash"), (2, "without best, VERY best day"), (3, "never really stupid"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words, steps = [*S.NEGATIONS, "without"], S.BOOSTERS | {"day": 0.1}
    a = score_sentiment(df, lex=FX.lexicon(spark), negations=words, boosters=steps)
    b = score_sentiment(df, lex=FX.lexicon(spark), negations=spark.createDataFrame([(w,) for w in words], "word string"),
                        boosters=spark.createDataFrame(list(steps.items()), "token string, increment double"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plain = {r.doc_id: r.compound for r in score_sentiment(df, lex=FX.lexicon(spark)).collect()}
    assert {r.doc_id: r.compound for r in b.collect()}[2] < 0 < plain[2]
    none = spark.createDataFrame([], "word string")
    assert score_sentiment(df, lex=FX.lexicon(spark), negations=none).count() == 4


def test_repeated_lexicon_tokens(spark):
    df = spark.createDataFrame([(1, "best day, not trash")], "doc_id long, text string")
    once, twice = FX.lexicon(spark), FX.lexicon(spark).union(FX.lexicon(spark))
    assert score_sentiment(df, lex=once).collect() == score_sentiment(df, lex=twice).collect()
    clash = once.union(spark.createDataFrame([("best", -1.0)], "token string, valence double"))
    with pytest.raises(Exception, match="two valences"):
        score_sentiment(df, lex=clash).collect()


def test_rows_with_one_id_are_scored_each(spark):
    rows = [(1, "best"), (1, "trash"), (1, "trash"), (2, None), (2, None), (None, "best"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.compound)) for r in score_sentiment(df, lex=FX.lexicon(spark)).collect())
    best, trash = norm(3.2), norm(-1.5)
    assert got == sorted([("1", str(best)), ("1", str(trash)), ("1", str(trash)), ("2", "None"), ("2", "None"),
                          ("None", str(best)), ("3", "0.0")])


def test_building_a_text_query_starts_no_job(spark):
    from marketmood.plans.catalog import QUERIES
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "build")
    for name in ("t6_sentiment_scores", "a1_daily_mean", "flagship_daily_features", "t13_encode_tokens", "t3_lemmatise"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("build-only")]
    assert all(len(j.stageIds) == 1 for j in jobs if j)  # schema reads only


def test_offset_free_strings_are_utc_in_any_session_zone(spark):
    import datetime as dt
    from marketmood.functions.dates import day_of, parse_utc, utc_day
    from marketmood.operators import rollups as R
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2022-09-29 02:00:00",), ("2022-09-29",), ("2022-09-28 22:00:00-04:00",), (None,)], "s string")
        ts = df.select(parse_utc("s").alias("ts"), F.lit("A").alias("symbol"), F.lit(1.0).alias("compound"))
        assert [r[0] for r in ts.select(utc_day("ts")).collect()][:3] == [dt.date(2022, 9, 29)] * 3
        assert [r[0] for r in ts.select(day_of(ts, "ts")).collect()][:3] == [dt.date(2022, 9, 29)] * 3
        seen = {r["date"]: r["n_posts"] for r in R.posts_per_day(ts.filter("ts IS NOT NULL"), "ts").collect()}
        assert seen == {dt.date(2022, 9, 29): 3}
        ntz = spark.sql("SELECT TIMESTAMP_NTZ '2022-09-29 02:00:00' AS ts")
        assert ntz.select(day_of(ntz, "ts")).first()[0] == dt.date(2022, 9, 29)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_utc_offsets_parse_to_utc_day(spark):
    from marketmood.functions.dates import parse_utc, utc_day
    df = spark.createDataFrame([("2022-09-29 23:41:16-05:00",), ("2022-09-29 23:41:16+00:00",),
                                ("not a date",)], "s string")
    got = [r[0] for r in df.select(utc_day(parse_utc("s"))).collect()]
    import datetime as dt
    assert got == [dt.date(2022, 9, 30), dt.date(2022, 9, 29), None]


def test_distinct_text_scores_equal_direct(spark):
    from marketmood.operators.sentiment import score_distinct_texts
    df = spark.createDataFrame([(1, "best"), (2, "best"), (3, "not best"), (4, None)], "doc_id long, text string")
    a = sorted(tuple(r) for r in score_sentiment(df, lex=FX.lexicon(spark)).collect())
    b = sorted(tuple(r) for r in score_distinct_texts(df, lex=FX.lexicon(spark)).select("doc_id", "neg", "neu", "pos", "compound").collect())
    assert a == b


def test_nfkd_normalisation_before_scoring(spark):
    # under NFKD the fullwidth letters become "best" (a lexicon word) and the
    # fullwidth "！" becomes "!", which adds emphasis
    df = spark.createDataFrame([(1, "ｂｅｓｔ！！"), (2, "best")], "doc_id long, text string")
    plain = {r.doc_id: r.compound for r in score_sentiment(df, lex=FX.lexicon(spark)).collect()}
    normed = {r.doc_id: r.compound for r in score_sentiment(df, lex=FX.lexicon(spark), normalize=True).collect()}
    assert plain[1] == 0.0
    assert normed[1] == norm(3.2 + 2 * 0.292)
    assert normed[2] == plain[2] == norm(3.2)


def test_nfkd_of_many_rows_is_arrow_to_arrow(spark):
    import unicodedata

    from pyspark.util import PythonEvalType
    texts = [None, "", "plain", "\ufb01 \u00e9\u0323", "\uac00\u1100\u1161", "\u2460\u33a5", "e\u0323\u0301"] * 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    out = [r.n for r in df.select("i", TX.nfkd("text").alias("n")).orderBy("i").collect()]
    assert out == [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    assert TX._nfkd.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def _of_plan(plan):
    """All operators of an executed plan, through its stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        yield from _of_plan(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _of_plan(children.apply(i))


@pytest.fixture
def shuffled_lexicon(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_shuffled_lexicon_moves_its_hits_and_splits_a_common_word(spark, shuffled_lexicon):
    n, words = 4000, 40  # every text: one common lexicon word among words that aren't in the lexicon
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.lit("word"), F.col("id") * 100 + k)), " ")
    docs = spark.range(n).repartition(8).select(F.col("id").alias("doc_id"), F.concat(plain, F.lit(" best")).alias("text"))
    lex = FX.lexicon(spark).union(spark.range(20_000).select(F.concat(F.lit("listed"), "id"), F.lit(1.0)))
    out = score_sentiment(docs, lex=lex)
    rows = out.collect()
    assert len(rows) == n and {r.compound for r in rows} == {norm(3.2)}
    plan = out._jdf.queryExecution().executedPlan()
    moved = [p.metrics().apply("shuffleRecordsWritten").value() for p in _of_plan(plan) if p.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert max(moved) < 40_000  # a header and a hit a text, and the lexicon: not the 164,000 tokens
    assert "SortMergeJoin(skew=true)" in plan.toString()


def test_predecessors_in_a_shuffled_lexicon_change_nothing(spark, shuffled_lexicon, monkeypatch):
    from marketmood.operators import sentiment as S
    words = dict(FX.DEMO_LEXICON) | {"not": -0.5, "very": 0.4, "least": 0.3, "at": 0.2, "isn't": -1.0, "doubt": -0.9, "kind": 2.0,
                                     "plain": 0.0, "so": 0.6, "été": 1.1}
    lex = spark.createDataFrame(list(words.items()), "token string, valence double")
    texts = ["not best", "isn't best", "isn't very best", "wasn't best", "never so best", "least best", "at least best", "very least best",
             "best at least trash", "kind of best", "KIND best day", "plain plain", "without doubt best", "VERY best but so-so ÉTÉ",
             "really NOT trash!! but hardly, barely best??", "aren't AT least best", "", " ", None, "best " * 300]
    rows = [(i % 15, t) for i, t in enumerate(texts)] + [(None, "not best"), (None, "not best"), (1, "isn't best")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idioms = {"so best": 1.7, "least best": -2.0, "best at least": 0.7}
    table = spark.createDataFrame(list(idioms.items()), "phrase string, valence double")

    def got(scores):
        return sorted(str(tuple(r)) for r in scores.select("doc_id", "neg", "neu", "pos", "compound").collect())

    plain, phrased = got(S.score_in_row(df, "text", words)), got(S.score_in_row(df, "text", words, phrases=idioms))
    assert plain != phrased
    assert got(score_sentiment(df, lex=lex)) == plain
    assert got(score_sentiment(df, lex=lex, phrases=table)) == phrased
    monkeypatch.setattr(S, "FILTER_BLOCKS", 1)  # a filter that is full lets words pass that aren't listed
    assert got(score_sentiment(df, lex=lex)) == plain
