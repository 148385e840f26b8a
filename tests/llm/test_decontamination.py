import math
import re

from marketmood.llm import decontamination as D


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def runs(text, widths):
    """What a document has: all runs of words of the widths that items have."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i:i + w]) for w in widths for i in range(len(words) - w + 1)}


def brute(docs, items, t=0.8):
    own = {}
    for i, text in items:
        if i is not None:
            own.setdefault(i, set()).update(shingles(text))
    out = set()
    for d, text in {(d, text) for d, text in docs}:
        s = runs(text, {x.count(" ") + 1 for q in own.values() for x in q})
        for i, q in own.items():
            if q and len(q & s) >= math.ceil(len(q) * t - 1e-9):
                out.add((d, i, len(q), len(q & s)))
    return out


def found(docs, items):
    return {(r["doc_id"], r["item_id"], r["n_item"], r["hits"]) for r in D.contained_items(docs, items).collect()}


def test_query_against_brute_force(docs, benchmark):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    want = brute(rows, items)
    assert want and found(docs, benchmark) == want


def test_changed_words_long_documents_and_short_items(spark):
    item = " ".join(f"q{k}" for k in range(40))
    filler = " ".join(f"f{k}" for k in range(30_000))
    one = item.split()
    one[20] = "changed"
    two = list(one)
    two[7] = "changed"
    rows = [(1, f"{filler}. {item.upper()}! {filler}"), (2, " ".join(one)), (3, " ".join(two)), (4, item[:len(item) // 2]),
            (5, "Two words"), (6, "say two words here"), (7, None), (8, ""), (None, item), (9, item), (9, item), (9, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "two words!"), (3, None), (4, "..."), (None, item), (5, "q1 q2 q3 q4 q5")],
                                  "item_id long, text string")
    want = brute(rows, [(1, item), (2, "two words!"), (3, None), (4, "..."), (5, "q1 q2 q3 q4 q5")])
    got = found(docs, items)
    assert got == want
    assert {(d, i) for d, i, _, _ in got if i == 1} == {(1, 1), (2, 1), (None, 1), (9, 1)}
    assert {d for d, i, _, _ in got if i == 2} == {5, 6}  # inside a longer text as well
    kept = D.drop_contaminated(docs.selectExpr("*", "1 AS row_key", "'x' AS shingle"), items)
    assert kept.columns == ["doc_id", "text", "row_key", "shingle"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, *_ in rows if d} - {d for d, *_ in want} | {9})


def test_edge_cases(edge_docs, no_docs, benchmark):
    assert D.drop_contaminated(edge_docs, benchmark).schema == edge_docs.schema
    assert D.drop_contaminated(edge_docs, benchmark).count() == edge_docs.count()
    assert D.contained_items(no_docs, benchmark).count() == 0
    assert D.contained_items(edge_docs, benchmark.limit(0)).count() == 0


def test_no_python_in_the_plan(docs, benchmark):
    plan = D.contained_items(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_an_id_are_dropped_too(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(30)) for c in "pr")
    docs = spark.createDataFrame([(1, f"before {first} after"), (2, f"before {second} after"), (3, "before and after"), (4, None),
                                  (5, " ".join(f"s{k}" for k in range(30)))], "doc_id long, text string")
    items = spark.createDataFrame([(None, first), (None, second), (None, None), (7, " ".join(f"s{k}" for k in range(30)))],
                                  "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, items).collect()) == [3, 4]
    assert {(r["doc_id"], r["item_id"]) for r in D.contained_items(docs, items).collect()} == {(5, 7)}


def test_short_items_inside_long_documents(spark):
    filler = " ".join(f"f{k}" for k in range(3000))
    rows = [(1, "The capital of France, as everyone says, is Paris."), (2, f"{filler} Capital-of France {filler}"), (3, "capital of"),
            (4, "capital of france"), (5, f"{filler} solo"), (6, "solo"), (7, ""), (8, "of france capital"), (9, f"one two three four {filler}")]
    items = [(1, "capital of france"), (2, "solo"), (3, "one two three four"), (4, "a b c d e f g"), (5, "capital of france"), (5, "solo")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = found(docs, bench)
    assert got == brute(rows, items)
    assert {(d, i) for d, i, _, _ in got} == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 2), (9, 3)}  # item 5 needs both
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()) == [3, 7, 8]
