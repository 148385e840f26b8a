import random
import zlib

import numpy as np
import pandas as pd

from marketmood.llm import toxicity

SMALL = toxicity.Settings(sample_rows=400, buckets=1 << 14, steps=60, batch=64)


def texts(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ta", "ro", "mi", "ne", "ku", "sal"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    insults = ["grobian", "dummkopf", "halunke"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy_and_unseen_misspellings():
    train, test = texts(300, 1), texts(150, 2)
    model = toxicity.train([t for t, _ in train], [y for _, y in train], SMALL)
    score = toxicity.score(pd.Series([t for t, _ in test]), model, {}).to_numpy()
    assert auc(score, np.array([y for _, y in test])) > 0.95
    clean = next(t for t, y in test if not y)
    spoilt = [clean + " " + w for w in ("dummkopff", "grobiann", "hallunke")]
    low, *high = toxicity.score(pd.Series([clean, *spoilt]), model, {})
    assert all(s > low for s in high)


def test_long_text_is_judged_by_its_worst_passage():
    train = texts(300, 1)
    model = toxicity.train([t for t, _ in train], [y for _, y in train], SMALL)
    clean = " ".join(t for t, y in train if not y)
    a, b = toxicity.score(pd.Series([clean, clean + " dummkopf halunke grobian dummkopf"]), model, {})
    assert b > a and b > 0.3


def test_word_scores_equal_the_mean_of_gram_weights():
    weights = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    known = {}
    toxicity.word_scores(["a", "haus", "日本"], weights, known)
    for w in ("a", "haus", "日本"):
        ids = toxicity.grams(w, len(weights))
        assert len(ids) == toxicity.n_grams(w)
        assert abs(known[w] - weights[ids].mean()) < 1e-6


def test_labels_of_one_kind_or_none():
    assert toxicity.score(pd.Series(["x", None]), toxicity.train([], [], SMALL), {}).max() < 0.01
    assert toxicity.score(pd.Series(["x", ""]), toxicity.train(["a", "b"], [1, 1], SMALL), {}).min() > 0.99


def test_held_out_rule_and_labels_that_may_teach(spark, docs, labels):
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    from pyspark.sql import functions as F
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_on(docs, labels, SMALL), toxicity.fit_on(docs, other, SMALL)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_query_and_edge_cases(spark, edge_docs, no_docs, labels):
    model = toxicity.train([t for t, _ in texts(60, 3)], [y for _, y in texts(60, 3)], SMALL)
    found = edge_docs.select("doc_id", toxicity.score_column(edge_docs["text"], model).alias("s")).collect()
    assert len(found) == edge_docs.count() and all(0 <= r["s"] <= 1 for r in found)
    empty = {r["s"] for r in found if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1
    kept = toxicity.reject_toxic(edge_docs, labels.limit(0))
    assert kept.schema == edge_docs.schema and kept.count() == edge_docs.count()
    assert toxicity.reject_toxic(no_docs, labels).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0), (2, 7)], "doc_id long, toxic int")
    assert toxicity.reject_toxic(edge_docs, odd).count() in range(edge_docs.count() + 1)


def test_an_id_with_very_many_rows_gives_few(spark, monkeypatch):
    rows = [(1, f"you idiot number {i}") for i in range(4000)] + [(1, "the same")] * 4000 + [(i, f"a kind word {i}") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, *_: seen.append((texts, y)))
    toxicity.fit_on(docs, labels)
    texts, y = seen[0]
    assert 0 < sum(y) <= 60 and len(set(texts)) == len(texts) and len(texts) - sum(y) > 15
