import contextlib
import io
import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from marketmood.operators.filters import for_symbols
from marketmood.plans import pipeline as P
from marketmood.sources import fixtures as FX


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["symbol", "date", "compound", "close", "ma7", "ma20", "upper_band", "lower_band",
                          "log_return"]


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_window_block_shares_one_exchange(spark):
    p = plan(P.daily_features(spark, SF0001))
    only_symbol = re.compile(r"hashpartitioning\(symbol#\d+, \d+\)")
    window_exchanges = [ln for ln in p.splitlines() if "Arguments" in ln and only_symbol.search(ln)]
    assert len(window_exchanges) == 1, window_exchanges


def test_sentiment_stays_in_jvm(spark):
    p = plan(P.document_scores(spark, SF0001, FX.lexicon(spark)))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "BroadcastHashJoin" in p
    p = plan(P.document_scores(spark, SF0001))  # scored inside the row
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "Exchange" not in p


def test_symbol_filter_reaches_scan(spark):
    p = plan(for_symbols(FX.prices(spark, SF0001), ["1-URGENT"]))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in p \
        or "In(o_orderpriority" in p or "EqualTo(o_orderpriority" in p


def test_scan_prunes_columns(spark):
    p = plan(FX.prices(spark, SF0001))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


FAST = ["flagship_daily_features", "t6_sentiment_scores", "a1_daily_mean", "a8_describe_prices",
        "w4_ema_recursive", "w6_ema_adjusted", "w10_sequences", "m1_hash_split", "m9_build_dataset",
        "a16_classification_report", "t13_encode_tokens", "g1_redact", "g3_size_rollup", "j2_align_to_dates"]


def _rows(records, cols):
    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        if isinstance(v, list):
            return "[" + ",".join(norm(x) for x in v) + "]"
        return repr(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", FAST)
def test_oracle_parity_sf0001(spark, name):
    con = duckdb.connect()
    for t in ["orders", "documents", "pages", "labels", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = E.queries()[name](spark, SF0001)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(cur.fetchall(), ocols)


def test_indicator_block_single_symbol_exchange(spark):
    from marketmood.operators import indicators as ind
    p = FX.prices(spark, SF0001)
    for method in ("frame", "block"):
        plan_text = plan(ind.technical_indicators(p, "close", ema_method=method))
        only_symbol = re.compile(r"hashpartitioning\(symbol#\d+, \d+\)")
        exchanges = [ln for ln in plan_text.splitlines() if "Arguments" in ln and only_symbol.search(ln)]
        assert len(exchanges) == 1, (method, exchanges)
        assert "BatchEvalPython" not in plan_text and "ArrowEvalPython" not in plan_text


def test_features_invariant_to_symbol_names_and_partitions(spark):
    from pyspark.sql import functions as F
    from marketmood.operators import indicators as ind
    p = FX.prices(spark, SF0001)
    base = ind.technical_indicators(p, "close")
    renamed = p.withColumn("symbol", F.reverse("symbol")).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = ind.technical_indicators(renamed, "close").withColumn("symbol", F.reverse("symbol"))
        cols = ["ma7", "ma20", "macd", "upper_band", "lower_band", "ema", "log_momentum"]
        a = sorted((r.symbol, r.date) + tuple(r[c] for c in cols) for r in base.collect())
        b = sorted((r.symbol, r.date) + tuple(r[c] for c in cols) for r in other.collect())
        assert a == b
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_text_partitions_are_the_callers_choice(spark):
    from marketmood.sources.readers import read_text_table
    sf = "/root/testdata/sf0.001"
    plan = lambda: read_text_table(spark, sf, "documents", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan()
    spark.conf.set("spark.marketmood.textPartitions", "4")
    try:
        assert "Repartition" in plan()
    finally:
        spark.conf.unset("spark.marketmood.textPartitions")
