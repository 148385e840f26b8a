"""Token-table operators.

Tokens are looked up in a dimension table (lemmas, vocabulary, stop words) by a
join that Spark plans by size. Lemmas move only the tokens that have one;
encodings look up the bounded head of each text in its row, sub-word encodings
explode it with its positions and regroup it by id and head, so rows that share
an id (or have none) stay rows of their own, and texts without tokens keep their
row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmood.functions.text import STOP_WORDS

# --- fixed values -----------------------------------------------------------
# Special token ids of the fixed-length encoding.
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3
N_SPECIAL = 4
# Lists that an encoding's vocabulary is dealt to by hash.
VOCAB_SLOTS = 4096
# Mark of a piece that goes on inside a word.
GOES_ON = "##"
# Noun endings that are taken off: (ending, what takes its place).
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
                ("men", "man"), ("ies", "y"))
# --- end of fixed values ----------------------------------------------------


def lemmatise(df: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
              out: str = "lemmas") -> DataFrame:
    """Replace every token found in ``lemmas(form, lemma)``; others stay as they are.

    Only tokens that meet the lemma table leave their row: their distinct
    replacements come back as a small map per id and text, and the token array is
    rewritten in place. Several lemmas of one form: the smallest is taken. Rows
    without an id, or with an id that repeats, are rewritten each; as the text
    is part of the key, they don't meet in one task.
    """
    lt = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    d = df.select(id_col, F.coalesce(tokens_col, F.array().cast("array<string>")).alias("_tokens"))
    # Rows whose hashes are equal by chance share a map of both texts' lemmas, which is right for each.
    d = d.withColumn("_row", F.xxhash64(id_col, "_tokens"))
    hits = (d.select(F.col("_row").alias("_hit"), F.explode(F.array_distinct("_tokens")).alias("form")).join(lt, "form")
            .groupBy("_hit").agg(F.collect_set(F.struct("form", "lemma")).alias("_found")))
    d = d.join(hits, F.col("_row") == F.col("_hit"), "left")
    found = F.map_from_entries(F.coalesce("_found", F.array().cast("array<struct<form:string,lemma:string>>")))
    return (d.withColumn("_map", found)
            .select(id_col, F.transform("_tokens", lambda t: F.coalesce(F.try_element_at("_map", t), t)).alias(out)))


def noun_lemmas(df: DataFrame, nouns: DataFrame, exceptions: DataFrame, tokens_col: str = "tokens",
                levels: int = 2) -> DataFrame:
    """T3 by rule: a table ``(form, lemma)`` of the tokens of ``df`` that have another noun as their lemma.

    A form in ``exceptions(form, lemma)`` has the shortest of itself and its
    listed lemmas that is in ``nouns(word)``. Any other is tried as it is and
    with each ending of ``NOUN_ENDINGS`` taken off; of those that are nouns the
    shortest is the lemma. If none is, endings are taken off once more, up to
    ``levels`` times. Forms without a noun are left out (and stay as they are
    in :func:`lemmatise`). Only distinct forms are resolved, by one join.
    """
    forms = df.select(F.explode(tokens_col).alias("form")).distinct()

    def without_ending(words):
        """Every word with every ending that fits taken off, in the order of the endings."""
        cut = F.transform(words, lambda w: F.array(*[
            F.when(F.endswith(w, F.lit(e)), F.concat(F.substr(w, F.lit(1), F.length(w) - len(e)), F.lit(r)))
            for e, r in NOUN_ENDINGS]))
        return F.filter(F.flatten(cut), lambda w: w.isNotNull() & (w != ""))

    def at_level(words, level):
        return F.transform(words, lambda w: F.struct(F.lit(level).alias("level"), w.alias("word")))

    words = F.array("form")
    tried = at_level(words, 1)
    for level in range(1, levels + 1):
        words = without_ending(words)
        tried = F.concat(tried, at_level(words, level))
    listed = exceptions.groupBy(F.col("form").alias("_f")).agg(F.sort_array(F.collect_set("lemma")).alias("_lemmas"))
    own = at_level(F.concat(F.array("form"), "_lemmas"), 1)
    each = (forms.join(listed, F.col("form") == F.col("_f"), "left")
            .select("form", F.posexplode(F.when(F.col("_lemmas").isNull(), tried).otherwise(own)).alias("place", "c")))
    known = nouns.select(F.col("word").alias("_word")).distinct()
    best = F.min_by("c.word", F.struct("c.level", F.length("c.word").alias("n"), "place"))
    found = each.join(known, F.col("c.word") == F.col("_word")).groupBy("form").agg(best.alias("lemma"))
    return found.filter("form <> lemma")


def drop_stopwords_join(df: DataFrame, stop: DataFrame | None = None, id_col: str = "doc_id",
                        tokens_col: str = "tokens") -> DataFrame:
    """Token rows ``(id, pos, tok)`` not in the stop-word table (left anti join).

    For long lists that do not fit an in-row literal; ``stop`` has one column
    ``word`` (defaults to the built-in list).
    """
    if stop is None:
        words = ", ".join("('" + w.replace("'", "\\'") + "')" for w in STOP_WORDS)
        stop = df.sparkSession.sql(f"SELECT word FROM VALUES {words} AS t(word)")  # a table of known size
    ex = df.select(id_col, F.posexplode(tokens_col).alias("pos", "tok"))
    return ex.join(stop, F.col("tok") == F.col("word"), "left_anti")


def build_vocab(df: DataFrame, tokens_col: str = "tokens", size: int = 1000) -> DataFrame:
    """The ``size`` most frequent tokens (ties by token) with ids from 4 on.

    Counting is a distributed aggregate; the top-k is a bounded ordered take,
    and only those ``size`` rows are numbered.
    """
    counts = df.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(size)
    w = Window.orderBy(F.col("n").desc(), F.col("token"))
    return top.withColumn("id", (F.row_number().over(w) + (N_SPECIAL - 1)).cast("bigint"))


def encode_tokens(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                  max_len: int = 160, padded: bool = True) -> DataFrame:
    """``[START] ids... [END]`` truncated to ``max_len``, with attention mask, right-padded unless told not to.

    Only the first ``max_len - 2`` tokens can appear in the encoding, so only
    those are looked up (the truncation is the operator's definition).
    Unknown tokens map to the UNK id. No row leaves its task: the vocabulary, which
    has a limit of rows, is one value (:func:`_vocab_slots`) that every row's
    tokens are looked up in, also where ids repeat or are NULL.
    """
    unknown = F.array(F.lit(UNK_ID).cast("bigint"))
    none = F.array().cast("array<string>")
    head = df.select(id_col, F.coalesce(F.slice(F.col(tokens_col), 1, max_len - 2), none).alias("_toks"))

    def ids(slots, token):
        found = F.filter(F.get(slots, F.pmod(F.xxhash64(token), F.lit(VOCAB_SLOTS)).cast("int")), lambda e: e["token"] == token)
        return F.coalesce(F.get(found, F.lit(0))["ids"], unknown)

    head = head.withColumn("_slots", _vocab_slots(vocab).scalar())
    return _framed(head.select(id_col, F.flatten(F.transform("_toks", lambda t: ids(F.col("_slots"), t))).alias("_ids")),
                   id_col, max_len, padded)


def _vocab_slots(vocab: DataFrame) -> DataFrame:
    """One row: the vocabulary as ``VOCAB_SLOTS`` lists of ``(token, ids)``, a token's list by its hash."""
    v = vocab.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.array_sort(F.collect_set(F.coalesce("id", F.lit(UNK_ID).cast("bigint")))).alias("ids"))
    by_slot = v.groupBy(F.pmod(F.xxhash64("token"), F.lit(VOCAB_SLOTS)).alias("slot")).agg(
        F.collect_list(F.struct("token", "ids")).alias("entries"))
    every = vocab.sparkSession.range(VOCAB_SLOTS).select(F.col("id").alias("slot")).join(by_slot, "slot", "left")
    slots = F.array_sort(F.collect_list(F.struct(
        "slot", F.coalesce("entries", F.array().cast("array<struct<token:string,ids:array<bigint>>>")).alias("entries"))))
    return every.agg(F.transform(slots, lambda s: s["entries"]).alias("slots"))


def _rows_again(ex: DataFrame, item, id_col: str) -> DataFrame:
    """``(id, _ids)``: items regrouped by row and hash, as often as the row came."""
    g = ex.groupBy("_row", "_hash").agg(
        F.array_sort(F.collect_set(item)).alias("_items"),
        F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).cast("int").alias("_copies"))
    return g.select(F.col("_row").alias(id_col), F.transform("_items", lambda s: s["v"]).alias("_ids"),
                    F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))


def _framed(g: DataFrame, id_col: str, max_len: int, padded: bool) -> DataFrame:
    """``(id, input_ids, attention_mask)``: start and end markers, padding."""
    ids = F.concat(F.array(F.lit(START_ID).cast("bigint")), F.col("_ids"), F.array(F.lit(END_ID).cast("bigint")))
    n = F.size(ids)
    pad = F.lit(max_len) - n if padded else F.lit(0)
    return g.select(
        id_col,
        F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1).cast("bigint"), n),
                 F.array_repeat(F.lit(0).cast("bigint"), pad)).alias("attention_mask"))


def piece_vocab(df: DataFrame, tokens_col: str = "tokens", words: int = 1000, pieces: int = 1000, longest: int = 4) -> DataFrame:
    """T14 for sub-words: ``(token, id)`` of whole words, word parts and single characters, by their counts.

    The ``words`` most frequent words, then the ``pieces`` most frequent parts of
    two to ``longest`` characters (parts that don't start a word are marked
    ``##``), then every character in both forms; ids go on from 4. Nothing is
    merged or learned: a vocabulary that comes with a model is used as it is.
    """
    counts = df.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    starts = F.sequence(F.lit(1), F.length("word"))
    part = counts.select("n", "word", F.explode(starts).alias("start")).select(
        "n", "start", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1)),
                                            lambda k: F.substr("word", F.col("start"), k))).alias("text"))
    part = part.select("n", F.concat(F.when(F.col("start") > 1, GOES_ON).otherwise(""), "text").alias("token"),
                       F.length("text").alias("size"))
    sums = part.groupBy("token", "size").agg(F.sum("n").alias("n"))
    most = lambda d, k: d.orderBy(F.col("n").desc(), "token").limit(k)
    all_parts = (most(counts.select(F.col("word").alias("token"), "n"), words).withColumn("rank", F.lit(0))
                 .unionByName(most(sums.filter("size > 1").select("token", "n"), pieces).withColumn("rank", F.lit(1)))
                 .unionByName(sums.filter("size = 1").select("token", "n").withColumn("rank", F.lit(2))))
    once = all_parts.groupBy("token").agg(F.min(F.struct("rank", (-F.col("n")).alias("less"))).alias("at"))
    w = Window.orderBy("at", "token")  # at most words + pieces + two rows a character
    return once.select("token", (F.row_number().over(w) + (N_SPECIAL - 1)).cast("bigint").alias("id"))


def word_pieces(words: DataFrame, vocab: DataFrame, longest: int = 100) -> DataFrame:
    """``(word, ids)``: greedy longest-match pieces of each distinct word; a word that can't be cut up is the UNK id.

    From the start of a word the longest piece in ``vocab(token, id)`` is taken,
    then the longest marked ``##`` from there, and so on. Words of more than
    ``longest`` characters are UNK. The pieces of all places are found by one
    join of word parts with the vocabulary; a fold picks the chain.
    """
    w = words.select("word").distinct().filter(F.col("word").isNotNull())
    short = w.filter(F.length("word").between(1, longest))
    part = short.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")).select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("start") + 1)).alias("size"))
    text = F.concat(F.when(F.col("start") > 1, GOES_ON).otherwise(""), F.substr("word", F.col("start"), F.col("size")))
    v = vocab.select(F.col("token").alias("_t"), "id")
    found = part.withColumn("_p", text).join(v, F.col("_p") == F.col("_t"))
    best = found.groupBy("word", "start").agg(F.max(F.struct("size", "id")).alias("b"))
    rows = best.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("start", "b.size", "b.id"))).alias("at"))
    none = F.array().cast("array<bigint>")

    def step(acc, p):
        here = p["start"] == acc["next"]
        return F.struct(F.when(here, p["start"] + p["size"]).otherwise(acc["next"]).alias("next"),
                        F.when(here, F.concat(acc["ids"], F.array(p["id"]))).otherwise(acc["ids"]).alias("ids"))

    chain = F.aggregate("at", F.struct(F.lit(1).alias("next"), none.alias("ids")), step)
    rows = rows.select("word", chain.alias("c")).filter(F.col("c.next") == F.length("word") + 1).select("word", "c.ids")
    unknown = F.array(F.lit(UNK_ID).cast("bigint"))
    return w.join(rows.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left").select(
        "word", F.coalesce("ids", unknown).alias("ids"))


def encode_pieces(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                  max_len: int = 160, padded: bool = True) -> DataFrame:
    """T13 with sub-words: as :func:`encode_tokens`, each token replaced by its pieces (:func:`word_pieces`).

    A token has at least one piece, so the first ``max_len - 2`` tokens are enough.
    """
    keep = max_len - 2
    head = df.select(F.col(id_col).alias("_row"), F.slice(F.col(tokens_col), 1, keep).alias("_toks"))
    pieces = word_pieces(head.select(F.explode("_toks").alias("word")), vocab).withColumnRenamed("ids", "_ids")
    ex = head.select("_row", F.xxhash64("_toks").alias("_hash"), F.posexplode_outer("_toks").alias("pos", "tok"))
    ex = ex.join(pieces, F.col("tok") == F.col("word"), "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("_ids", F.array(F.lit(UNK_ID).cast("bigint"))).alias("v")))
    g = _rows_again(ex, item, id_col)
    return _framed(g.withColumn("_ids", F.slice(F.flatten("_ids"), 1, keep)), id_col, max_len, padded)
