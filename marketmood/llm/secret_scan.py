"""Secret scans: base rules, and character Markov models compared by log-likelihood ratio.

Base rules find assignments, access keys and long hex runs. Two first-order
Markov models over characters, one of random strings and one of ordinary
identifiers, then judge what base spans leave of every other long run of key
characters: a run whose log-likelihood ratio reaches ``MIN_RATIO`` a character
is a span of kind ``markov``. In other runs every stretch counts whose ratios,
less ``COST`` a character, sum to ``MIN_SUM``, so that ordinary characters
before or after a key don't dilute it; it is widened to whole words, which must
have ``MIN_STRETCH`` characters in all.

Runs beside letters of scripts without case (Chinese, Arabic) are judged like
others. Beside another letter, as ``ä``, what touches it is part of a word.

The models are counts of character pairs, trained from labelled samples: the
values that the base rules find in a bounded sample of documents and strings
drawn uniformly from the usual key alphabets are random; the other words of
the sample, alone and joined as identifiers join them, and identifiers made of
listed words of programs and languages in every usual case and with every usual
joint, are ordinary; either half weighs as much as the other. UUIDs, and what
has few letters or few different characters (rulers, numbers, time stamps), are
ordinary by their form.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import free_name, hash_fraction, read_table

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
# Access keys of 20+ and hex runs of 24+ characters lie inside runs of 20+ key characters.
MIN_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_=-]{2,}")

# Key alphabets (fixed values): hex, upper base 32, base 36, base 62, base 64.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
CHARS = ALPHABETS[4] + "_=-."
CODE = {c: i for i, c in enumerate(CHARS)}
EDGE = len(CHARS)
SIZE = EDGE + 1

UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")

# Labelled ordinary words, of programs and of languages written with plain letters.
PROGRAM_WORDS = (
    "abstract access account action adapter address alert allocate array async attribute auth backup batch binary block buffer "
    "build button cache callback chain channel char check class client clone code column command commit config connect console "
    "content context control count create credential cursor database debug default delete deploy descriptor device directory "
    "document element encode engine error event exception execute export extract factory fetch field filter flag format function "
    "generate graph handler hash header height hidden html http image import index input instance integer interface iterator json "
    "kernel label layout length level library limit listener load local logger manager mapping memory message method metric module "
    "monitor mutex network notify number object offset option output package").split()
LANGUAGE_WORDS = (
    "Gesellschaft Geschwindigkeit Versicherung Rechtsschutz Bundesverfassung Krankenhaus Schmetterling cymdeithas llyfrgell "
    "gwyddoniaeth ysgrifennydd llywodraeth cwmwl przedsiebiorstwo szczescie wszystkie chrzaszcz niebieski rzeczpospolita "
    "lentokone yhteiskunta kirjasto kysymys tyttöystävä anticonstitutionnellement bibliotheque aujourd'hui quelquefois "
    "desarrollo ayuntamiento izquierda trabajador sviluppo bellissimo ringraziamento geschiedenis verantwoordelijk "
    "utbildning sjukhus kunskap degerlendirme cumhuriyet ogretmen zmrzlina ctvrtek prvni megszentsegtelenithetetlen egeszsegedre "
    "quotidianus exspectatio kesempatan pertanyaan mwanafunzi kujitegemea etxekoak hizkuntza nguyen truong "
    "hajimemashite shinkansen zhongguo xuesheng").split()

SAMPLE_ROWS = 4000
BY_CLASS = 0.4
MIN_RATIO = 0.2
# Stretches of a run: least sum of ratios less the cost a character, least length and different characters.
COST = 0.1
MIN_SUM = 8.5
MIN_CORE = 10  # characters of a stretch before it is widened
MAX_FALL = 18.0
MIN_STRETCH = 16
MIN_KINDS = 8
MIN_LETTERS = 4
BLOCK = 1 << 16  # characters at a time


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules' matches, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    for run in RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def codes(word: str) -> list[int]:
    return [EDGE, *[CODE[c] for c in word], EDGE]


def count_pairs(words, counts: np.ndarray) -> None:
    """Add the character pairs of each word (edges included) to a SIZE x SIZE table."""
    flat = np.fromiter((c for w in words for c in codes(w)), np.int64)
    if len(flat):
        pairs = flat[:-1] * SIZE + flat[1:]
        # between two words stands the pair (edge, edge), which no word has
        counts += np.bincount(pairs[pairs != EDGE * SIZE + EDGE], minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def uniform_samples(per_alphabet: int = 400, length: int = 32, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=length)) for alphabet in ALPHABETS for _ in range(per_alphabet)]


def identifiers(words: list[str], count: int = 6000, seed: int = 12) -> list[str]:
    """Labelled ordinary strings: one to six words in camel, constant, snake, kebab, path and run-on forms, some with numbers."""
    rng = random.Random(seed)
    words = ["".join(c for c in w if c in CODE) for w in words]
    forms = (lambda ws: ws[0] + "".join(w.capitalize() for w in ws[1:]), lambda ws: "".join(w.capitalize() for w in ws),
             lambda ws: "_".join(ws).upper(), "_".join, "-".join, "/".join, "".join, lambda ws: "".join(ws).upper(),
             lambda ws: "-".join(w.capitalize() for w in ws), lambda ws: ws[0].upper() + "".join(w.capitalize() for w in ws[1:]),
             lambda ws: "=".join(ws), lambda ws: "-".join(ws).upper())
    out = []
    for k in range(count):
        chosen = [rng.choice(words).lower() for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.15:
            chosen.insert(rng.randint(1, len(chosen)), rng.choice(("v", "", "x", "utf", "sha")) + str(rng.choice((1, 2, 3, 8, 16, 64, 256, 2024))))
        out.append(forms[k % len(forms)](chosen))
    return out + [x for s in ("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm", "0123456789") for x in (s, s.upper(), s[::-1])]


def sample_words(text: str) -> tuple[list[str], list[str]]:
    """(ordinary, random) words of one text by its base spans; neighbours are also joined into identifiers."""
    spans = base_spans(text)
    secret = [text[a:b] for a, kind, b in spans if kind]
    secret += [m.group(1) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    cut, at = [], 0
    for a, _, b in spans:
        cut.append(text[at:a])
        at = max(at, b)
    plain = PLAIN.findall(" ".join([*cut, text[at:]]))
    joints = ("_", "-", "/", "", ".", "=")
    both = [a + joints[i % 6] + (b.capitalize() if i % 6 == 3 else b) for i, (a, b) in enumerate(zip(plain[::2], plain[1::2]))]
    return plain + both, [w for w in ("".join(c for c in s if c in CODE) for s in secret) if w]


def ratio_table(ordinary: np.ndarray, rand: np.ndarray) -> np.ndarray | None:
    """Log-likelihood ratio of each character pair; None without ordinary words."""
    return np.log(likelihoods(rand)) - np.log(likelihoods(ordinary)) if ordinary.sum() else None


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Probability of each next character, by pairs and, with weight ``BY_CLASS``, by classes of characters.

    The classes (upper, lower, digits, others, edge) tell how often case and
    kind change, and let pairs pass that no labelled word of the language had.
    """
    pairs = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    member = np.eye(5)[[0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in CHARS] + [4]]
    change = member.T @ counts @ member + 1
    change /= change.sum(axis=1, keepdims=True)
    single = counts.sum(axis=0) + 1.0
    within = single / (member @ (member.T @ single))  # share of a character in its class
    return (1 - BY_CLASS) * pairs + BY_CLASS * (member @ change @ member.T) * within


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS):
    """Pair table of the two models from about ``sample_rows`` documents (by a hash of the id).

    Each task counts its share; two tables of 69 x 69 sums are all that the driver gets.
    """
    share = sample_rows / max(docs.count(), 1)

    def count(batches):
        tables = np.zeros((2, SIZE, SIZE), np.int64)
        for batch in batches:
            for t in batch["t"]:
                for table, words in zip(tables, sample_words(t)):
                    count_pairs(words, table)
        label, pair = np.nonzero(tables.reshape(2, -1))
        yield pd.DataFrame({"label": label, "pair": pair, "n": tables.reshape(2, -1)[label, pair]})

    rows = (docs.filter(hash_fraction(F.col(id_col), share) & F.col(text).isNotNull()).select(F.col(text).alias("t"))
            .mapInPandas(count, "label long, pair long, n long")
            .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect())
    tables = np.zeros((2, SIZE * SIZE), np.float64)
    for r in rows:
        tables[r["label"], r["pair"]] = r["n"]
    found, rand = tables.reshape(2, SIZE, SIZE)
    return ratio_table(with_samples(found, identifiers(PROGRAM_WORDS + LANGUAGE_WORDS)), with_samples(rand, uniform_samples()))


def with_samples(found: np.ndarray, samples: list[str]) -> np.ndarray:
    """Counts of labelled samples, and of what was found with as much weight in all."""
    out = np.zeros((SIZE, SIZE), np.int64)
    count_pairs(samples, out)
    return out + found * (out.sum() / found.sum()) if found.sum() else out


def ratio(word: str, table: np.ndarray) -> float:
    """Mean log-likelihood ratio of the word's character pairs."""
    c = codes(word)
    return float(table[c[:-1], c[1:]].mean())


def stretches(word: str, table: np.ndarray):
    """(start, end) of the stretches of a run that the models call random, widened to whole words.

    One pass: a stretch ends where the sum has fallen to nothing, or by MAX_FALL
    from its highest; what follows is looked at anew.
    """
    c = np.fromiter((CODE[x] for x in word), np.int64, len(word))
    total = most = 0.0
    start = first = end = done = at = 0
    for k in range(0, len(c) - 1, BLOCK):
        for score in (table[c[k:k + BLOCK][:len(c) - 1 - k], c[k + 1:k + 1 + BLOCK]] - COST).tolist():
            if total <= 0:
                total, start = 0.0, at
                if most < MIN_SUM:
                    most = 0.0
            total += score
            at += 1
            if total > most:
                most, first, end = total, start, at + 1
            if most >= MIN_SUM and total <= most - MAX_FALL:
                yield from widened(word, max(first, done), end)
                done, total, most = end, 0.0, 0.0
    if most >= MIN_SUM:
        yield from widened(word, max(first, done), end)


def varied(word: str) -> bool:
    """Whether a string has as many letters and different characters as keys have, and isn't mostly an alphabet in order."""
    return (len(set(word)) >= MIN_KINDS and sum(map(str.isalpha, word)) >= MIN_LETTERS
            and 2 * sum(ord(b) - ord(a) == 1 for a, b in zip(word, word[1:])) < len(word))


def widened(word: str, a: int, b: int):
    """A stretch with the rest of its first and last words, if it is long and varied enough."""
    if b - a < MIN_CORE:
        return
    while a < b and word[a] == "=":
        a += 1
    while a and word[a - 1].isalnum():
        a -= 1
    while b < len(word) and word[b].isalnum():
        b += 1
    while b < len(word) and word[b] == "=":
        b += 1
    if b - a >= MIN_STRETCH and varied(word[a:b]):
        yield a, b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            a, b = min(a, out[-1][0]), max(b, out.pop()[1])
        out.append((a, b))
    return out


def joins(letter: str) -> bool:
    """Whether a character beside a run makes it a part of a longer word: a letter with case, or a digit."""
    return letter.isalnum() and not (letter.isalpha() and letter.lower() == letter.upper())


def all_spans(text: str | None, table: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Base spans and the runs that the models call random; null and empty texts have none."""
    text = text or ""
    base = base_spans(text)
    if table is None:
        return base
    more = []
    for run in RUN.finditer(text):
        first, last = run.span()
        cuts, at = [], first  # what the base spans and UUIDs leave
        for s, e in sorted([(s, e) for s, _, e in base] + [m.span() for m in UUID.finditer(text, first, last)]):
            if s < last and first < e:
                cuts.append((at, s))
                at = max(at, e)
        for a, b in [*cuts, (at, last)]:
            if b - a < MIN_STRETCH:
                continue
            left, right = a == first and a and joins(text[a - 1]), b == last and b < len(text) and joins(text[b])
            if not left and not right and b - a >= MIN_RUN and varied(text[a:b]) and ratio(text[a:b], table) >= MIN_RATIO:
                more.append((a, 3, b))
                continue
            at_run = [(a + s, a + e) for s, e in stretches(text[a:b], table)]
            for s, e in merged(at_run):
                if not (left and s == a) and not (right and e == b):  # else a part of a longer word in another script
                    more.append((s, 3, e))
    return sorted(base + more)


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_column(text, table):
    """Struct of counts, the base spans and all spans of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = all_spans(t, table)
            base = [s for s in found if s[1] < 3]
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), told(base), told(found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])

    return scan(text)


def redact_text(text: str | None, table, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones as one) replaced by ``mark``; None if there is none."""
    out, at = [], 0
    for a, _, b in all_spans(text, table):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]]) if out else None


def redact_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """Every row of ``docs``; found secrets are replaced in the text, and ``length`` (if a column) follows."""
    table = train(docs, text, id_col)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, table) for t in texts], dtype=object)

    new = free_name(docs, "clean")
    out = docs.withColumn(new, clean(docs[text]))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(new).isNotNull(), F.char_length(new).cast(kind)).otherwise(F.col(length)))
    return out.withColumn(text, F.coalesce(F.col(new), F.col(text))).drop(new)


def op1_secret_scan(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", scan_column(docs["text"], train(docs)).alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex",
                        F.sha2(F.col("s.base"), 256).alias("base_sha256"), "s.spans")
