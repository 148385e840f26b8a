"""Every stage of the pipeline against a brute-force version, on what its predecessor kept."""

import random

import pytest

import corpus_pipeline as P
from marketmood.llm import packing, secret_scan, toxicity
from marketmood.llm.common import stored

from .test_decontamination import brute as brute_leaks
from .test_packing import check as check_packing
from .test_packing import library_ids
from .test_secret_scan import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage over the fixture; some rows are planted after the first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    key = "".join(random.Random(3).choices(secret_scan.ALPHABETS[3], k=40))
    plain = [f"p{i}" for i in range(80)]
    planted = [(5001, " ".join(plain), "en", "s", 1), (5002, " ".join([*plain[:40], "zz", *plain[41:]]), "en", "s", 1),
               (5003, "before " + item + " after it", "en", "s", 1), (5004, f"my key {key} ok here", "en", "s", 1),
               (5005, None, None, None, None), (5006, "", "en", "s", 0)]
    out = [docs]
    for name, stage in P.STAGES:
        made = stage(spark, out[-1], SF)
        if len(out) == 1:
            made = made.union(spark.createDataFrame(planted, docs.schema))
        out.append(stored(made, f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_duplicates", "benchmark_decontamination", "secret_scans", "packing"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_toxicity(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    model = toxicity.fit_on(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    known = {}
    want = {k for k, r in before.items() if toxicity.score([r["text"]], model, known)[0] < 0.3}
    assert {k for k in after if k < 5001 or k > 5006} == want
    assert len(want) > 0.75 * len(before)


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    fp = {k: brute_fingerprint(r["text"]) for k, r in before.items()}
    ids = sorted(fp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(fp[a] ^ fp[b]).count("1") <= 4]
    assert set(after) == set(brute_components(ids, links).values())


def test_decontamination(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_leaks([(k, r["text"]) for k, r in before.items()], items)}
    assert set(after) == set(before) - leaks and 5003 in leaks


def test_secrets(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys()
    for k, r in before.items():
        old, new = r["text"], after[k]["text"]
        if not brute_spans(old) and k != 5004:
            continue
        assert new != old and not brute_spans(new) and after[k]["n_chars"] == len(new)
        first = brute_spans(old)[0][0] if k != 5004 else len("my key ")
        assert new.startswith(old[:first] + "[SECRET]")
    same = sum(after[k]["text"] == r["text"] for k, r in before.items())
    assert same >= len(before) - sum(bool(brute_spans(r["text"])) for r in before.values()) - 3


def test_packing(steps):
    ids = {k: library_ids(r["text"]) for k, r in rows(steps[4]).items()}
    waste, total = check_packing(steps[5].collect(), ids)
    assert waste / total < 0.03


def test_run_equals_its_stages(spark):
    out = P.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.select("doc_id").distinct().count() > 700
    assert P.ORACLE_SQL is None and packing.CAPACITY == 2048


def test_edge_cases(spark, edge_docs, no_docs):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs, n in ((edge_docs, None), (no_docs, 0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns and base == out.columns[:5]
            docs = stored(out, "test-edge")
        assert docs.count() == 0 if n == 0 else docs.count() > 0
