import datetime as dt

from pyspark.sql import functions as F

from marketmood.operators import redact as RD
from marketmood.streaming import live as LV


def test_parse_rules():
    lits, rxs = RD.parse_rules(["foo", "literal:bar==>B", "regex:a+b", "glob:*.txt==>T", ""])
    assert lits == [("foo", "***REMOVED***"), ("bar", "B")]
    assert rxs[0] == ("a+b", "***REMOVED***") and rxs[1][1] == "T"


def test_redact_order_and_binary(spark):
    df = spark.createDataFrame([("foo aab foo",), ("x\x00 foo",)], "t string")
    rules = ["foo==>f", "regex:f a+b==>R"]
    got = [r[0] for r in df.select(RD.redact("t", rules)).collect()]
    assert got == ["R f", "x\x00 foo"]


def test_glob_to_regex(spark):
    df = spark.createDataFrame([("a/b.txt",), ("a/b.txs",), ("c.txt",)], "name string")
    rx = "^(?:" + RD.glob_to_regex("*.txt") + ")$"
    assert [r[0] for r in df.filter(F.col("name").rlike(rx)).collect()] == ["a/b.txt", "c.txt"]


def test_size_rollup(spark):
    df = spark.createDataFrame([("a/b/c.txt", 10), ("a/d.py", 5), ("e", 1)], "name string, size long")
    got = {(r.kind, r.key): r.size for r in RD.size_rollup(df).collect()}
    assert got[("directory", "")] == 16 and got[("directory", "a")] == 15 and got[("directory", "a/b")] == 10
    assert got[("extension", ".txt")] == 10 and got[("extension", "")] == 1 and got[("path", "a/d.py")] == 5


def test_extension_rules(spark):
    df = spark.createDataFrame([("x/.bashrc",), ("a.b.c",), ("d/",), ("e.",)], "name string")
    got = [r[0] for r in df.select(RD.extension(F.col("name"))).collect()]
    assert got == ["", ".c", "", "."]


def test_deleted_since(spark):
    df = spark.createDataFrame([("a.txt", dt.date(2020, 1, 1)), ("b.txt", dt.date(2021, 1, 1)),
                                ("c.py", None), ("d.py", dt.date(2020, 5, 1))], "name string, deleted_at date")
    got = {r.extension: r.deleted_since for r in RD.deleted_since(df).collect()}
    assert got == {".txt": dt.date(2021, 1, 1), ".py": None}


def test_select_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("srcx/b.py",), ("docs/c.md",)], "name string")
    got = sorted(r[0] for r in RD.select_paths(df, match=["src"], renames=[("src", "lib")]).collect())
    assert got == ["lib/a.py"]
    inv = sorted(r[0] for r in RD.select_paths(df, match=["src"], invert=True).collect())
    assert inv == ["docs/c.md", "srcx/b.py"]


def test_content_groups(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    got = {r.name: r.n_names for r in RD.content_groups(df, "doc_id", "text").collect()}
    assert got == {"1": 2, "2": 2, "3": 1}


def test_rules_without_a_pattern_and_arrows():
    lits, rxs = RD.parse_rules(["regex:", "a==>b==>c", "literal:", "==>x", "glob:[!a]?*\n", "regex:x==>"])
    assert lits == [("regex:", "***REMOVED***"), ("a==>b", "c"), ("literal:", "***REMOVED***")]
    assert rxs == [("(?s)[^a]..*", "***REMOVED***"), ("x", "")]


def test_globs_against_the_standard_library(spark):
    import fnmatch
    names = ["a", "ab", "a.b", "[", "]", "a]b", "x^y", "a/b.txt", "A", "a-b", "b", "-", "!"]
    for glob in ("*", "?", "a*", "[ab]", "[!ab]", "[]a]", "[!]a]*", "x[^]y", "a[.-]b", "[", "*[]]*", "a.b", "*.txt", "[a-c]"):
        rx = "^(?:" + RD.glob_to_regex(glob) + ")$"
        got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").filter(F.col("n").rlike(rx)).collect()]
        assert got == [n for n in names if fnmatch.fnmatchcase(n, glob)], glob


def test_root_counts_once_and_mixed_renames(spark):
    df = spark.createDataFrame([("/a/b.txt", 5), ("c", 1)], "name string, size long")
    got = {(r.kind, r.key): (r.size, r.n) for r in RD.size_rollup(df).collect()}
    assert got[("directory", "")] == (6, 2) and got[("directory", "/a")] == (5, 1)
    df = spark.createDataFrame([("src/a.py",), ("lib/a.py",), ("src",)], "name string")
    out = RD.select_paths(df, match=[""], changes=[("regex", "^lib/", "src/"), ("prefix", "src", "new"), ("regex", "\\.py$", ".txt")])
    assert sorted(r[0] for r in out.collect()) == ["new", "new/a.txt", "new/a.txt"]
    base = RD.select_paths(df, glob=["a.*"], base_name=True)
    assert sorted(r[0] for r in base.collect()) == ["lib/a.py", "src/a.py"]


def test_append_windows_and_live_table_equal_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.repartition(3).write.parquet(f"{tmp_path}/events.parquet")

    def bars(events):
        return LV.live_bars(events, "ts", "event_type", "value")
    want = {(r.symbol, r.date): r for r in bars(ev).collect()}
    for i, folder in enumerate((sf, str(tmp_path))):  # a single file, a folder of part files
        closed = LV.run_available(spark, bars(LV.table_stream(spark, folder, "events.parquet")), "test").collect()
        assert 0 < len(closed) < len(want)
        assert all(want[r.symbol, r.date] == r for r in closed)
        live = LV.LiveTable(spark, f"{tmp_path}/live{i}", LV.bar_parts("ts", "event_type", "value"), LV.merge_bar_parts)
        got = LV.bars_of(live.run(LV.table_stream(spark, folder, "events.parquet")).table()).collect()
        assert len(got) == len(want) and {(r.symbol, r.date): r for r in got} == want
