"""Toxicity classifier: subword bags averaged into a linear softmax, trained in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with word
boundaries, hashed into buckets), a passage the mean of its distinct words, and
a linear softmax reads the passage; vectors and softmax are trained jointly by Adagrad.
Misspellings that were never seen share most n-grams with the words they spoil;
words are also spoilt at random during training so that weight spreads over all
of a word's n-grams.

Labels belong to whole texts, and one insult in a long text would drown in its
average. A text is therefore cut into passages of about 20 words, and its logit
is that of its worst passage. Training alternates: passages of toxic texts
start with their text's label, then only the worst passage of each text keeps
it; of clean texts the three worst passages are shown. A two-parameter
logistic curve, fitted on a fifth of the sample kept apart, turns the logit
into the score.

The model is linear, so a trained word is one number, and scoring is a mean of
looked-up numbers inside a pandas UDF.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import hash_fraction, read_table, stored, text_pieces

WORD = re.compile(r"\w+")
PASSAGE = 20
# Words without a say that every passage is averaged with, so that one odd word alone doesn't decide.
PADDING = 15
CACHE_WORDS = 500_000


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_chars`` bound what reaches the trainer, half of it of each label.

    Texts are taken whole; long ones make the sample smaller in rows.
    """

    sample_rows: int = 5000
    sample_chars: int = 40_000_000
    texts_of_id: int = 20
    buckets: int = 1 << 19
    dim: int = 8
    rate: float = 0.3
    gain: float = 10.0
    rounds: int = 3
    steps: int = 150
    batch: int = 192
    spoil: float = 0.3
    seed: int = 7


@dataclass
class Model:
    weights: np.ndarray  # one number a bucket: toxic minus clean logit
    bias: float
    slope: float
    offset: float


def grams(word: str, buckets: int) -> list[int]:
    """Bucket of every 3- to 5-gram of the word between boundary marks."""
    marked = f"<{word}>"
    return [zlib.crc32(marked[i:i + n].encode()) & (buckets - 1)
            for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))]


def n_grams(word: str) -> int:
    return sum(max(1, len(word) + 3 - n) for n in (3, 4, 5))


def passage_starts(n_words: int) -> np.ndarray:
    """First word of each of about n / PASSAGE passages of equal length."""
    k = max(1, round(n_words / PASSAGE))
    return np.arange(k) * n_words // k


def word_scores(words: list[str], weights: np.ndarray, known: dict) -> None:
    """Put the number of each word into ``known``, which is emptied first when full."""
    new = set(words).difference(known)
    if new:
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        new = list(new)
        ids = [grams(w, len(weights)) for w in new]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = weights[np.fromiter((i for g in ids for i in g), np.int64, int(sizes.sum()))]
        means = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.float64) / sizes
        known.update(zip(new, means.tolist()))


def text_logit(text: str | None, model: Model, known: dict) -> float:
    """Logit of the worst passage; a text without words has the bias alone."""
    worst = None
    for block in text_pieces(text):
        words = WORD.findall(block.lower())
        if words:
            at = passage_starts(len(words)).tolist()
            word_scores(words, model.weights, known)
            for a, b in zip(at, [*at[1:], len(words)]):
                bag = set(words[a:b])
                mean = sum(map(known.__getitem__, bag)) / (len(bag) + PADDING)
                worst = mean if worst is None or mean > worst else worst
    return model.bias + (worst or 0.0)


def _spoilt(word: str, rng) -> str:
    i, kind = int(rng.integers(len(word))), int(rng.integers(3))
    if kind == 0 and len(word) > 3:
        return word[:i] + word[i + 1:]
    if kind == 1 or len(word) < 2:
        return word[:i] + word[i] + word[i:]
    i = min(i, len(word) - 2)
    return word[:i] + word[i + 1] + word[i] + word[i + 2:]


class _Trainer:
    """Vocabulary, passages and parameters of one training run (bounded sample, driver memory)."""

    def __init__(self, texts: list[str], s: Settings):
        self.s, self.rng = s, np.random.default_rng(s.seed)
        vocab: dict[str, int] = {}
        self.passages = []  # per text: word numbers of its passages
        for text in texts:
            own = []
            for block in text_pieces(text):
                ids = np.array([vocab.setdefault(w, len(vocab)) for w in WORD.findall(block.lower())], np.int32)
                if len(ids):
                    own += [np.unique(p) for p in np.split(ids, passage_starts(len(ids))[1:])]
            self.passages.append(own)
        words = list(vocab)
        n = len(words)
        words += [_spoilt(w, self.rng) for w in words]
        self.spoilt_from = n
        self.size = np.fromiter((n_grams(w) for w in words), np.int64, len(words))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.gram = np.fromiter((i for w in words for i in grams(w, s.buckets)), np.int32, int(self.at[-1]))
        self.vec = np.zeros((s.buckets, s.dim), np.float32)  # n-grams that were never seen say nothing
        self.vec_g = np.full(s.buckets, 1e-6, np.float32)
        self.soft = self.rng.normal(0, 0.1, (s.dim + 1, 2))
        self.soft_g = np.full(self.soft.shape, 1e-6)

    def _word_grams(self, word_ids):
        """Positions in ``gram`` of all n-grams of the words, one after the other."""
        sizes = self.size[word_ids]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return self.gram[np.arange(sizes.sum()) - np.repeat(first - self.at[word_ids], sizes)], first, sizes

    def step(self, bags: list[np.ndarray], y: np.ndarray):
        s = self.s
        flat = np.concatenate(bags)
        flat = np.where(self.rng.random(len(flat)) < s.spoil, flat + self.spoilt_from, flat)
        lens = np.fromiter(map(len, bags), np.int64, len(bags))
        owner = np.repeat(np.arange(len(bags)), lens)
        uniq, inv = np.unique(flat, return_inverse=True)
        ids, first, sizes = self._word_grams(uniq)
        word_vec = np.add.reduceat(self.vec[ids], first, axis=0) / sizes[:, None]
        hidden = np.add.reduceat(word_vec[inv], np.concatenate(([0], np.cumsum(lens)[:-1])), axis=0) * s.gain / (lens + PADDING)[:, None]
        hidden = np.hstack([hidden, np.full((len(bags), 1), 2 * s.gain)])  # lets the bias learn as fast as words do
        logits = hidden @ self.soft
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad_soft, grad_hidden = hidden.T @ p / len(y), (p @ self.soft[:-1].T) * s.gain / (lens + PADDING)[:, None]
        per_word = np.stack([np.bincount(inv, grad_hidden[owner, k], len(uniq)) for k in range(s.dim)], axis=1)
        spread = np.repeat(per_word / sizes[:, None], sizes, axis=0)
        bucket, binv = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(binv, spread[:, k], len(bucket)) for k in range(s.dim)], axis=1)
        self.vec_g[bucket] += (grad * grad).mean(axis=1)
        self.vec[bucket] -= (s.rate * grad / np.sqrt(self.vec_g[bucket])[:, None]).astype(np.float32)
        self.soft_g += grad_soft * grad_soft
        self.soft -= s.rate / 3 * grad_soft / np.sqrt(self.soft_g)

    def weights(self) -> tuple[np.ndarray, float]:
        side = self.soft[:, 1] - self.soft[:, 0]
        return (self.vec @ side[:-1] * self.s.gain).astype(np.float32), float(side[-1] * 2 * self.s.gain)

    def passage_logits(self) -> list[np.ndarray]:
        weights, bias = self.weights()
        words = np.add.reduceat(weights[self.gram], self.at[:-1], dtype=np.float64) / self.size
        return [np.array([words[p].sum() / (len(p) + PADDING) for p in own]) + bias for own in self.passages]

    def learn(self, shown: list[tuple[np.ndarray, int]]):
        """``steps`` minibatches, passing over the shown passages as often as it takes."""
        order = np.concatenate([self.rng.permutation(len(shown))
                                for _ in range(-(-self.s.steps * self.s.batch // len(shown)))])
        for i in range(0, self.s.steps * self.s.batch, self.s.batch):
            part = [shown[k] for k in order[i:i + self.s.batch]]
            self.step([b for b, _ in part], np.array([y for _, y in part]))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets (Newton steps)."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, z.T @ (p - target) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def train(texts: list[str], labels: list[int], settings: Settings = Settings(), odds: float | None = None) -> Model:
    """Fit the model on a bounded list of texts with labels 0 or 1.

    ``odds`` (toxic to clean, over all labels) undoes the sample's balance in the score.
    Without texts of both labels (or without any words) the score is the share
    of toxic texts, 0 for no texts.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(settings.buckets, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    t = _Trainer(texts, settings)
    apart = np.zeros(len(y), bool)
    for label in (0, 1):  # a fifth of each label, kept for the curve
        apart[np.flatnonzero(y == label)[4::5]] = True
    own = [i for i in range(len(y)) if not apart[i] and t.passages[i]]
    some = lambda i, k: [t.passages[i][j] for j in t.rng.permutation(len(t.passages[i]))[:k]]
    if own:
        t.learn([(p, int(y[i])) for i in own for p in some(i, 3)])
    for _ in range(settings.rounds if own else 0):
        logits = t.passage_logits()
        shown = []
        for i in own:
            worst = np.argsort(-logits[i], kind="stable")
            if y[i]:
                shown.append((t.passages[i][worst[0]], 1))
            else:
                shown += [(t.passages[i][j], 0) for j in worst[:3]]
        t.learn(shown)
    weights, bias = t.weights()
    known: dict = {}
    held = np.flatnonzero(apart) if len(set(y[apart])) == 2 else np.arange(len(y))
    model = Model(weights, bias, 1.0, 0.0)
    model.slope, model.offset = _curve(np.array([text_logit(texts[i], model, known) for i in held]), y[held])
    if odds:
        model.offset += float(np.log(odds) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score(texts: pd.Series, model: Model, known: dict) -> pd.Series:
    x = np.array([text_logit(t, model, known) for t in texts], np.float64)
    return pd.Series(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -50, 50))))


def score_column(text, model: Model):
    """Score in [0, 1] of a text column; null and empty texts get the score of no words."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            yield score(texts, model, known)

    return scores(text)


def is_held_out(id_col) -> F.Column:
    """Rows that labels are never learnt from: crc32 of the id's text is 2 modulo 4 (false for null ids)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text",
           id_col: str = "doc_id", label: str = "toxic") -> Model:
    """Train on at most about ``sample_rows`` labelled rows that aren't held out.

    Each label gives up to half of the sample, chosen by a hash of the id. Null
    labels and ids are left out; an id with several labels counts as toxic if
    any says so. An id that repeats in ``docs`` gives each different text once,
    of more than ``texts_of_id`` rows about that many, chosen by a hash.
    """
    marked = (labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y"))
              .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("k")))
              .groupBy("k").agg(F.max("y").alias("y")))
    of_id = F.least(F.lit(1.0), settings.texts_of_id / F.count(F.lit(1)))  # share of an id's rows that may be taken
    sizes = (docs.select(F.col(id_col).alias("k"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"))
             .groupBy("k").agg(of_id.alias("own"), F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n")))
    marked = sizes.join(marked, "k").select("k", "y", "own", (F.col("own") * F.col("n_rows")).alias("n_rows"),
                                            (F.col("own") * F.col("n")).alias("n"))
    marked = stored(marked, "labelled-ids")
    totals = {r["y"]: r for r in marked.groupBy("y").agg(F.sum("n_rows").alias("rows"), F.sum("n").alias("chars")).collect()}
    counts = {y: r["rows"] for y, r in totals.items()}
    picked = None
    for y, r in sorted(totals.items()):
        share = min(settings.sample_rows / 2 / r["rows"], settings.sample_chars / 2 / max(r["chars"], 1))
        part = marked.filter((F.col("y") == y) & hash_fraction(F.col("k"), share))
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return train([], [], settings)
    # The picked side has about sample_rows ids of 20 bytes: a proven bound for the broadcast.
    chance = F.pmod(F.xxhash64("h", F.lit("row")), F.lit(1_000_000)) < F.col("own") * 1_000_000
    sample = (docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
              .withColumn("h", F.xxhash64("t")).join(F.broadcast(picked.select("k", "y", "own")), "k").filter(chance)
              .dropDuplicates(["k", "h"]).select("k", "t", "y").toPandas().sort_values(["k", "t"], kind="stable"))
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    return train(sample["t"].tolist(), sample["y"].tolist(), settings, odds)


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_on(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
                         score_column(docs["text"], model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = fit_on(docs, labels, text=text, id_col=id_col)
    return docs.filter(score_column(docs[text], model) < threshold)
