"""Text column functions.

All of them are built-in Spark expressions (JVM side, whole-stage codegen)
except ``nfkd``, which has no builtin and runs as an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# English stop words dropped by the cleaning step (the NLTK English list,
# 179 entries, in its published order).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don don't should should've now d "
    "ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't "
    "needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won "
    "won't wouldn wouldn't"
).split()

# Word characters = letters, digits, underscore (Unicode aware, identical in
# Java and RE2 regex dialects).
WORD_CLASS = r"[\p{L}\p{N}_]"
# A word token or a single non-space symbol.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_\s]"
URL_PATTERN = r"http\S+"
# Treebank splitting of lower-case text whose spaces are doubled and that starts and ends with them: quotes, runs of
# periods and dashes, symbols, commas and colons, closing periods, clitics, contractions. (pattern, replacement), in order.
TREEBANK_RULES = (
    (r"([ (\[{<])\"", "$1 `` "),
    (r"\"|''", " '' "),
    (r"([“”„«»‘])", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&?!*()<>{}\[\]])", " $1 "),
    (r"(--+)", " $1 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([^ .][^ .])\.((?:''|[ '”’»)\]}>])* )", "$1 .  $2"),
    (r"([^ '])('s|'m|'d|'ll|'re|'ve|n't|') ", "$1  $2 "),
    (r" (can)(not) ", " $1  $2 "),
    (r" (gim|lem)(me) ", " $1  $2 "),
    (r" (gon|wan)(na) ", " $1  $2 "),
    (r" (got)(ta) ", " $1  $2 "),
    (r" (d)('ye) ", " $1  $2 "),
    (r" (more)('n) ", " $1  $2 "),
    (r" ('t)(is|was) ", " $1  $2 "),
)
# Labels of the 3-class sentiment encoding.
LABEL_NAMES = ("Negative", "Neutral", "Positive")
# --- end of fixed values ----------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c) -> Column:
    """Remove ``http\\S+`` runs (case-sensitive, applied before lowercasing)."""
    return F.regexp_replace(_c(c), URL_PATTERN, "")


def word_tokens(c) -> Column:
    """Lowercase and split into word runs or single symbols."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def treebank_tokens(c) -> Column:
    """T2 with Treebank splitting: clitics ("do n't", "it 's"), "can not", "gon na", quotes as `` and '', "..." and "--" whole.

    One cascade of replacements over the row's text. Without a sentence model
    every word's closing period is split off, except after single letters and
    abbreviations that hold periods ("e.g.", "u.s.").
    """
    out = F.concat(F.lit("  "), F.regexp_replace(F.lower(_c(c)), r"\s+", "  "), F.lit("  "))
    for pattern, replacement in TREEBANK_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.filter(F.split(out, " +"), lambda t: t != "")


def drop_stopwords(tokens, words=STOP_WORDS) -> Column:
    """T4: keep tokens not in the stop-word list (order preserved)."""
    # ``isin`` over many literals is planned as a hash-set lookup (InSet).
    words = list(words)
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def clean_text(c, words=STOP_WORDS, tokens=word_tokens) -> Column:
    """T1 -> T2 -> T4 -> T5: cleaned text; ``tokens`` may be :func:`treebank_tokens`.

    After stop-word removal every token loses its non-word symbols; emptied
    tokens are kept, so the space join can yield double spaces, as in the
    original cleaning step.
    """
    toks = drop_stopwords(tokens(strip_urls(c)), words)
    stripped = F.transform(toks, lambda t: F.regexp_replace(t, NON_WORD_PATTERN, ""))
    return F.array_join(stripped, " ")


def text_length(c) -> Column:
    """Length in code points (NULL-safe), as BIGINT."""
    return F.length(_c(c)).cast("bigint")


def sign_category(c) -> Column:
    """<0 Negative, >0 Positive, anything else (0, NULL, NaN) Neutral."""
    x = _c(c)
    return (F.when(x.isNull() | F.isnan(x), F.lit("Neutral"))
            .when(x < 0, F.lit("Negative"))
            .when(x > 0, F.lit("Positive"))
            .otherwise(F.lit("Neutral")))


def threshold_label(c, cuts=(0.4, 0.6), null_as: int | None = None) -> Column:
    """Score <= cuts[0] -> 0, <= cuts[1] -> 1, else 2 (NULL -> ``null_as``)."""
    x = _c(c)
    lo, hi = cuts
    lab = F.when(x <= F.lit(float(lo)), 0).when(x <= F.lit(float(hi)), 1).otherwise(2)
    fallback = F.lit(null_as) if null_as is not None else F.lit(None)
    return F.when(x.isNull(), fallback.cast("bigint")).otherwise(lab.cast("bigint"))


def decode_label(c) -> Column:
    """0/1/2 -> Negative/Neutral/Positive."""
    x = _c(c)
    out = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(LABEL_NAMES))):
        out = F.when(x == i, F.lit(name)).otherwise(out)
    return out


@F.arrow_udf(T.StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    # A few rows at a time: Python strings of the whole batch never stand beside each other.
    done = [pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKD", t) for t in part], texts.type)
            for part in (texts.slice(i, 100).to_pylist() for i in range(0, len(texts), 100))]
    return pa.concat_arrays(done) if done else texts


def nfkd(c) -> Column:
    """Unicode NFKD normalisation (Arrow-batched; NULL stays NULL)."""
    return _nfkd(_c(c))
