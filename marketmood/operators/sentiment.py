"""Lexicon-and-rule sentiment scoring.

Rules follow the published valence-aware method (Hutto & Gilbert, 2014):
whitespace tokens with outer punctuation stripped, lexicon valence,
all-caps emphasis, boosters/dampeners and negation among the three preceding
tokens, a "least" negation, the "but" shift, ``!``/``?`` emphasis and the
``s / sqrt(s^2 + 15)`` normalisation.

Plan shape, the same for a lexicon of any size:

* per text, array functions build the tokens and the per-text scalars (token
  count, caps differential, first "but", emphasis);
* tokens are exploded with their three predecessors and their successor; those
  that a bit filter of the lexicon (of a fixed size) lets pass are joined with
  it, so that a lexicon too large to be broadcast shuffles its hits and few
  tokens besides. Of the predecessors only those that can change a score go along;
* hits and one header row per text are aggregated by id and text hash with
  map-side partial aggregation, so the text itself is never shuffled. No
  per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.functions.numeric import round_half_up
from marketmood.functions.text import nfkd

# --- fixed values -----------------------------------------------------------
# ASCII punctuation (the same 32 characters as Python's string.punctuation).
PUNCT_CLASS = "[!-/:-@\\[-`{-~]"
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Whitespace separating tokens.
WS_PATTERN = "[\\t\\n\\x0B\\f\\r ]+"
# Method constants.
B_INCR = 0.293          # booster increment
B_DECR = -0.293         # dampener increment
C_INCR = 0.733          # all-caps emphasis
N_SCALAR = -0.74        # negation multiplier
ALPHA = 15.0            # normalisation constant
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
EXCL_STEP = 0.292       # per "!" (at most 4 counted)
QM_STEP = 0.18          # per "?" when 2-3 of them
QM_MAX = 0.96           # more than 3 "?"
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
# Default negation words (demo set) -- any word containing "n't" also negates.
NEGATIONS = ("no", "not", "never")  # fuller sets: see score_sentiment
# Default booster / dampener words (demo subset).
BOOSTERS = {
    "very": B_INCR, "really": B_INCR, "extremely": B_INCR, "so": B_INCR,
    "most": B_INCR, "more": B_INCR, "totally": B_INCR, "absolutely": B_INCR,
    "slightly": B_DECR, "barely": B_DECR, "somewhat": B_DECR, "less": B_DECR,
    "hardly": B_DECR, "kinda": B_DECR,
}
# Rules that come with a phrase table: "never so"/"never this" strengthens, "without doubt" cancels the negation.
NEVER_SO = 1.25
INTENSE = ("so", "this")
# Shapes of the token runs that may be a phrase, as offsets from the hit; longer ones are tried first.
PHRASE_RUNS = ((-3, -2, -1, 0), (-2, -1, 0), (-1, 0, 1), (0, 1, 2), (-1, 0), (0, 1))
# Blocks of 64 bits that the words of a lexicon are hashed to (2 MB for any lexicon), two bits a word.
FILTER_BLOCKS = 1 << 18
# --- end of fixed values ----------------------------------------------------


def vader_tokens(text: Column) -> Column:
    """Whitespace tokens; outer punctuation stripped unless <= 2 chars remain."""
    raw = F.filter(F.split(text, WS_PATTERN), lambda t: t != F.lit(""))

    def strip(t):
        s = F.btrim(t, F.lit(PUNCT_CHARS))
        return F.when(F.length(s) <= 2, t).otherwise(s)

    return F.transform(raw, strip)


def is_upper(t: Column) -> Column:
    """Has a cased character and no lower-case one."""
    return (F.upper(t) == t) & (F.lower(t) != t)


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def emphasis(text: Column) -> Column:
    """Punctuation amplifier from ``!`` and ``?`` counts."""
    ex = F.least(_count_char(text, "!"), F.lit(4)) * F.lit(EXCL_STEP)
    qm = _count_char(text, "?")
    qa = F.when(qm > 3, F.lit(QM_MAX)).when(qm > 1, qm * F.lit(QM_STEP)).otherwise(F.lit(0.0))
    return (ex + qa).cast("double")


def _lookup(key: Column, table) -> Column:
    if isinstance(table, Column):
        return F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    if not table:
        return F.lit(0.0)
    m = F.create_map(*[x for w, v in table.items() for x in (F.lit(w), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, key), F.lit(0.0))


def _lexicon(lex: DataFrame) -> DataFrame:
    """One row per token; a token listed with two valences fails the query, exact repeats collapse."""
    clash = F.concat(F.lit("two valences in the lexicon for: "), F.col("_lk"))
    return (lex.groupBy(F.col("token").alias("_lk"))
            .agg(F.min("valence").alias("_lo"), F.max("valence").alias("_val"))
            .select("_lk", F.when(F.col("_lo") == F.col("_val"), F.col("_val"))
                    .otherwise(F.raise_error(clash).cast("double")).alias("_val")))


def _place(word: Column) -> tuple[Column, Column]:
    """A word's block in the bit filter, and its bits in that block."""
    h = F.xxhash64(word)
    at = [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int") for k in (18, 24)]
    first, second = [F.call_function("shiftleft", F.lit(1).cast("bigint"), k) for k in at]
    return h.bitwiseAND(F.lit(FILTER_BLOCKS - 1)).cast("int"), first.bitwiseOR(second)


def _filter_bits(lexicon: DataFrame) -> DataFrame:
    """One row: the blocks of the lexicon's bit filter as an array of ``FILTER_BLOCKS`` longs."""
    block, bits = [c.alias(name) for c, name in zip(_place(F.col("_lk")), ("block", "bits"))]
    every = lexicon.sparkSession.range(FILTER_BLOCKS).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("bigint").alias("bits"))
    by_block = lexicon.select(block, bits).unionByName(every).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return by_block.agg(F.sort_array(F.collect_list(F.struct("block", "bits")))["bits"].alias("bits"))


def _may_be_listed(word: Column, filter_bits: Column) -> Column:
    """False only for words that aren't in the lexicon; how many others pass depends on how full the filter is."""
    block, bits = _place(word)
    return F.get(filter_bits, block).bitwiseAND(bits) == bits


def _negated(word: Column, negations) -> Column:
    lw = F.lower(word)
    listed = F.array_contains(negations, lw) if isinstance(negations, Column) else lw.isin(list(negations))
    return listed | F.contains(lw, F.lit("n't"))


def _in_context(tok: Column, val: Column, before, i: Column, bi: Column, capdiff: Column, boosters, negations,
                phrase: Column | None = None) -> Column:
    """Valence of one hit: caps, then boosters and negation of the preceding tokens, "least" and "but".

    ``before`` holds for distances 1 to 3 the token (or NULL) and whether it is
    in the lexicon itself; they are applied in that order as one fold. With a
    phrase table, ``phrase`` is the valence of the run around the hit (or NULL)
    and takes the place of what the fold gives.
    """
    def factor(d):
        p = before[d - 1][0]
        out = F.when(_negated(p, negations), F.lit(N_SCALAR))
        if phrase is not None and d > 1:
            between = [F.lower(before[k][0]) for k in range(d - 1)]
            some = lambda words: F.coalesce(F.greatest(*[b.isin(*words) for b in between], F.lit(False)), F.lit(False))
            out = (F.when((F.lower(p) == "never") & some(INTENSE), F.lit(NEVER_SO))
                   .when((F.lower(p) == "without") & some(("doubt",)), F.lit(1.0)).when(_negated(p, negations), F.lit(N_SCALAR)))
        return out.otherwise(F.lit(1.0))

    v0 = val + F.when(is_upper(tok) & capdiff,
                      F.when(val > 0, F.lit(C_INCR)).otherwise(F.lit(-C_INCR))).otherwise(F.lit(0.0))
    steps = F.array(*[F.struct(p.alias("p"), k.alias("k"), F.lit(damp).alias("damp"), factor(d).alias("factor"))
                      for d, ((p, k), damp) in enumerate(zip(before, DISTANCE_DAMPING), 1)])

    def step(acc, e):
        p = e["p"]
        applies = p.isNotNull() & ~e["k"]
        b = _lookup(F.lower(p), boosters)
        scalar = F.when(b != 0, F.when(acc < 0, -b).otherwise(b)
                        + F.when(is_upper(p) & capdiff,
                                 F.when(acc > 0, F.lit(C_INCR)).otherwise(F.lit(-C_INCR)))
                        .otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
        moved = acc + F.when(applies, scalar * e["damp"]).otherwise(F.lit(0.0))
        return moved * F.when(applies, e["factor"]).otherwise(F.lit(1.0))

    (p1, k1), (p2, _) = before[:2]
    least = (F.lower(p1) == "least") & ~k1 & (p2.isNull() | ~F.lower(F.coalesce(p2, F.lit(""))).isin("at", "very"))
    but_factor = (F.when((bi >= 0) & (i < bi), F.lit(BUT_BEFORE))
                  .when((bi >= 0) & (i > bi), F.lit(BUT_AFTER)).otherwise(F.lit(1.0)))
    folded = F.aggregate(steps, v0, step)
    folded = folded if phrase is None else F.coalesce(phrase, folded)
    return folded * F.when(least, F.lit(N_SCALAR)).otherwise(F.lit(1.0)) * but_factor


def _run(token, offsets) -> Column:
    """The lower-case run of tokens at these offsets, NULL where it leaves the text."""
    return F.lower(F.concat(*[x for k in offsets for x in (F.lit(" "), token(k))][1:]))


# Words that a lexicon may have to be carried inside each row's expression.
IN_ROW_WORDS = 50_000


def lexicon_words(lex: DataFrame, most: int = IN_ROW_WORDS) -> dict[str, float]:
    """A lexicon table as a dict, for :func:`score_in_row`; raises beyond ``most`` words or on two valences of a word."""
    rows = _lexicon(lex).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words: score a stored table with score_sentiment")
    return {r["_lk"]: float(r["_val"]) for r in rows}


def score_in_row(df: DataFrame, text_col: str = "text", lex: dict[str, float] | DataFrame | None = None,
                 negations=NEGATIONS, boosters=None, normalize: bool = False,
                 phrases: dict[str, float] | None = None) -> DataFrame:
    """T6 without moving a row: ``df`` with columns ``neg, neu, pos, compound``.

    The same rules as :func:`score_sentiment`, as one expression over the row's
    own tokens, so it may stand in a stream before a watermark or a window. The
    lexicon is part of the expression: membership is a hash-set test, and a
    hit's valence is found among the sets of words that share one. Columns of
    the result's names are replaced.
    """
    words = lexicon_words(lex) if isinstance(lex, DataFrame) else dict(lex or {})
    boosters = BOOSTERS if boosters is None else boosters

    def known(t):
        return F.coalesce(F.lower(t).isin(list(words)), F.lit(False)) if words else F.lit(False)

    def valued(table):
        by_valence: dict[float, list[str]] = {}
        for w, v in table.items():
            by_valence.setdefault(float(v), []).append(w)

        def of(text):
            out = None
            for v, group in by_valence.items():
                out = (F if out is None else out).when(text.isin(group), F.lit(v))
            return F.lit(None).cast("double") if out is None else out
        return of

    valence, idiom = valued(words), valued(phrases or {})

    out = ["neg", "neu", "pos", "compound"]
    kept = [c for c in df.columns if c not in out or c == text_col]
    names = {k: f"_score_{k}" for k in ("toks", "n", "caps", "amp", "but", "hits", "vals")}
    toks, n, caps, amp, but, hits, vals = (F.col(x) for x in names.values())
    text = nfkd(F.col(text_col)) if normalize else F.col(text_col)
    d = df.withColumn("_score_text", text)
    d = d.withColumn(names["toks"], vader_tokens(F.col("_score_text"))).withColumns({
        names["n"]: F.size(toks), names["amp"]: emphasis(F.col("_score_text")),
        names["caps"]: F.size(F.filter(toks, is_upper)),
        names["but"]: F.array_position(F.transform(toks, F.lower), "but") - 1})
    cap = (caps > 0) & (caps < n)

    def is_hit(t, i):
        skip = F.lower(t).isin(list(boosters)) if boosters else F.lit(False)
        kind_of = (F.lower(t) == "kind") & (F.lower(F.coalesce(F.get(toks, i + 1), F.lit(""))) == "of")
        return F.when(known(t) & ~skip & ~kind_of, i)

    def value(i):
        before = [(F.get(toks, i - k), known(F.get(toks, i - k))) for k in (1, 2, 3)]
        runs = None if phrases is None else F.coalesce(*[idiom(_run(lambda k: F.get(toks, i + k), run)) for run in PHRASE_RUNS])
        return _in_context(F.get(toks, i), valence(F.lower(F.get(toks, i))), before, i, but, cap, boosters, negations, runs)

    d = d.withColumn(names["hits"], F.filter(F.transform(toks, is_hit), lambda i: i.isNotNull()))
    d = d.withColumn(names["vals"], F.transform(hits, value))

    def total(f, keep):
        return F.aggregate(F.filter(vals, keep), F.lit(0.0), lambda acc, v: acc + f(v))

    d = d.withColumns({
        "_score_s": total(lambda v: v, lambda v: v.isNotNull()), "_score_ps": total(lambda v: v + 1, lambda v: v > 0),
        "_score_ns": total(lambda v: v - 1, lambda v: v < 0), "_score_nz": F.size(F.filter(vals, lambda v: v != 0))})
    scores = _shares(n, amp, F.col("_score_s"), F.col("_score_ps"), F.col("_score_ns"), F.col("_score_nz"))
    # A generator of one row: a filter on a score stays above it and isn't worked out by a copy of all expressions.
    return d.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[s.alias(c) for c, s in zip(out, scores)]))))


def score_sentiment(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    lex: DataFrame | None = None, negations=NEGATIONS, boosters=None,
                    normalize: bool = False, broadcast_lexicon: bool = False,
                    phrases: DataFrame | None = None) -> DataFrame:
    """``(id, neg, neu, pos, compound)`` for every row of ``df``.

    ``lex`` is a ``(token, valence)`` table of lower-case tokens. NULL text
    gives NULL scores (T8); empty text gives zeros. Every row is scored on its
    own, also where ids repeat. Spark knows the size of a lexicon read from a
    file or given as VALUES and broadcasts a small one; ``broadcast_lexicon``
    says so for a small table of unknown size (such as ``createDataFrame``). It is
    read three times: store one that is costly to make.
    ``negations`` are words or a small table ``(word)``, ``boosters`` a dict or
    a small table ``(token, increment)``. ``phrases`` is a table ``(phrase,
    valence)`` of two to four lower-case words, one of them in the lexicon: a run
    of tokens around a hit (shapes in ``PHRASE_RUNS``, longer ones first) that is
    in it gives the hit its valence, in place of the word's own, of boosters and
    of negation; it also turns on the rules for "never so" and "without doubt".
    """
    if lex is None:
        raise ValueError("a lexicon table (token, valence) is required")
    boosters = BOOSTERS if boosters is None else boosters
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if normalize:
        base = base.withColumn("_text", nfkd(F.col("_text")))
    toks = base.select("_id", F.xxhash64("_text").alias("_th"), "_text", vader_tokens(F.col("_text")).alias("_toks"))
    per = toks.select(
        "_id", "_th", "_toks",
        F.size("_toks").alias("_n"),
        F.size(F.filter("_toks", is_upper)).alias("_ncaps"),
        emphasis(F.col("_text")).alias("_amp"),
        (F.array_position(F.transform("_toks", F.lower), "but") - 1).alias("_bi"),
    ).withColumn("_capdiff", (F.col("_ncaps") > 0) & (F.col("_ncaps") < F.col("_n")))

    # One generator per text: each token with its three predecessors and its
    # successor, then a header row (no token, position n) that keeps texts
    # without hits; shifted arrays are longer than the text, so there is always one.
    none = F.lit(None).cast("string")
    shifted = [F.concat(F.array(*[none] * d), F.col("_toks")).alias(f"p{d}") for d in (1, 2, 3)]
    after = [F.slice("_toks", 1 + d, F.greatest("_n", F.lit(1))).alias(x) for d, x in ((1, "nx"), (2, "n2"))]
    zipped = F.arrays_zip(F.col("_toks").alias("tok"), *shifted, *after[:1 if phrases is None else 2])
    succ = ["_it.nx"] if phrases is None else ["_it.nx", "_it.n2"]
    items = (per.select("_id", "_th", "_n", "_amp", "_capdiff", "_bi", F.posexplode_outer(zipped).alias("i", "_it"))
             .filter(F.col("i").isNull() | (F.col("i") <= F.col("_n")))
             .select("_id", "_th", "_n", "_amp", "_capdiff", "_bi", "_it.tok", "_it.p1", "_it.p2", "_it.p3", *succ,
                     F.when(F.col("i") < F.col("_n"), F.col("i")).otherwise(-1).alias("i")))

    # Word tables become one array and one map, read once per query and put beside the rows.
    extra = {}
    if isinstance(negations, DataFrame):
        words = negations.agg(F.coalesce(F.collect_set(F.lower("word")), F.array().cast("array<string>"))).scalar()
        extra["_negations"], negations = words, F.col("_negations")
    if isinstance(boosters, DataFrame):
        pairs = boosters.groupBy(F.lower("token").alias("t")).agg(F.max("increment").cast("double").alias("v"))
        extra["_boosters"] = pairs.agg(F.map_from_entries(F.collect_list(F.struct("t", "v")))).scalar()
        boosters = F.col("_boosters")

    def boosts(word):
        if isinstance(boosters, Column):
            return F.coalesce(F.map_contains_key(boosters, F.coalesce(F.lower(word), F.lit(""))), F.lit(False))
        return F.lower(word).isin(list(boosters)) if boosters else F.lit(False)

    def matters(word):
        """Words that change a hit they precede, unless they are in the lexicon themselves."""
        rules = ("least",) if phrases is None else ("least", "never", "without")
        return boosts(word) | _negated(word, negations) | F.lower(word).isin(*rules)

    # Tokens that can't be in the lexicon end here, as do hits that the rules skip.
    is_hit = F.col("i") >= 0
    lexicon = F.broadcast(_lexicon(lex)) if broadcast_lexicon else _lexicon(lex)
    items = items.filter(~is_hit | _may_be_listed(F.lower("tok"), _filter_bits(lexicon).scalar())).withColumns(extra)
    skip = boosts(F.col("tok")) | ((F.lower("tok") == "kind") & (F.lower(F.coalesce("nx", F.lit(""))) == "of"))
    items = items.filter(~is_hit | ~skip)

    # Lexicon membership of the predecessors, asked only where it decides something: the lexicon's few words
    # that can change a hit are one array. Without a phrase table the other predecessors aren't carried on.
    both = lexicon.withColumns(extra).filter(matters(F.col("_lk"))).agg(F.collect_set("_lk")).scalar()
    items = items.withColumn("_both", both).withColumns({
        f"k{d}": F.coalesce(F.array_contains("_both", F.lower(f"p{d}")), F.lit(False)) for d in (1, 2, 3)}).drop("_both")
    if phrases is None:
        least = F.lower("p1") == "least"
        items = items.withColumns({
            "p1": F.when(matters(F.col("p1")), F.col("p1")), "p2": F.when(matters(F.col("p2")) | least, F.col("p2")),
            "p3": F.when(matters(F.col("p3")), F.col("p3"))}).drop("nx")
    items = items.withColumns({c: F.when(~is_hit, F.col(c)) for c in ("_n", "_amp")})

    # Rows without a word get a key of their own, so none pile up on a null key. The word's hash is a second key:
    # the lexicon, grouped by word, is shuffled once more by it, and Spark parts the hits of a very common word
    # only where both sides of a join come straight from a shuffle.
    own = F.concat(F.lit("\x00"), F.col("_th").cast("string"))
    key = F.coalesce(F.lower("tok"), own)
    hits = items.drop(*extra).join(lexicon.withColumn("_lh", F.xxhash64("_lk")),
                                   (F.xxhash64(key) == F.col("_lh")) & (key == F.col("_lk")), "left")
    hits = hits.filter(~is_hit | F.col("_lk").isNotNull()).withColumns(extra)

    phrase = None
    if phrases is not None:
        table = _lexicon(phrases.withColumnRenamed("phrase", "token")).withColumnRenamed("_val", "_idiom")
        names = {-3: "p3", -2: "p2", -1: "p1", 0: "tok", 1: "nx", 2: "n2"}
        for at, run in enumerate(PHRASE_RUNS):
            side = table.select(F.col("_lk").alias(f"_run{at}"), F.col("_idiom").alias(f"_idiom{at}"))
            text = F.coalesce(_run(lambda k: F.col(names[k]), run), own)
            hits = hits.join(side, text == F.col(f"_run{at}"), "left").drop(f"_run{at}")
        phrase = F.coalesce(*[F.col(f"_idiom{at}") for at in range(len(PHRASE_RUNS))])
    before = [(F.col(f"p{d}"), F.col(f"k{d}")) for d in (1, 2, 3)]
    v = _in_context(F.col("tok"), F.col("_val"), before, F.col("i"), F.col("_bi"), F.col("_capdiff"), boosters, negations,
                    phrase)
    hits = hits.select("_id", "_th", "_n", "_amp", "i", v.alias("_v"))

    # Rows that repeat an id and a text fall together: their sums are divided by
    # the number of headers, and they are written out as often.
    vcol = F.when(is_hit, F.col("_v"))
    copies = F.count(F.when(~is_hit, 1))
    agg = hits.groupBy("_id", "_th").agg(
        copies.alias("copies"), F.max("_n").alias("n"), F.max("_amp").alias("amp"),
        (F.sum(vcol) / copies).alias("s"),
        (F.sum(F.when(vcol > 0, vcol + 1)) / copies).alias("ps"),
        (F.sum(F.when(vcol < 0, vcol - 1)) / copies).alias("ns"),
        (F.count(F.when(vcol != 0, 1)) / copies).alias("nz"))
    each = agg.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _finish(each).withColumnRenamed("_id", id_col)


def _shares(n: Column, amp: Column, s: Column, ps: Column, ns: Column, nz: Column) -> tuple[Column, ...]:
    """``neg, neu, pos, compound`` from a text's token count, emphasis and sums over its hits."""
    s = F.coalesce(s, F.lit(0.0))
    s2 = F.when(s > 0, s + amp).when(s < 0, s - amp).otherwise(s)
    comp = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s2 / F.sqrt(s2 * s2 + F.lit(ALPHA))))
    ps = F.coalesce(ps, F.lit(0.0))
    ns = F.coalesce(ns, F.lit(0.0))
    ps2 = F.when(ps > F.abs(ns), ps + amp).otherwise(ps)
    ns2 = F.when(ps < F.abs(ns), ns - amp).otherwise(ns)
    neu_n = (n - nz).cast("double")
    total = ps2 + F.abs(ns2) + neu_n
    empty = n == 0

    def share(x):
        return (F.when(n.isNull(), F.lit(None).cast("double")).when(empty, F.lit(0.0))
                .otherwise(round_half_up(F.abs(x / total), 3)))

    return (share(ns2), share(neu_n), share(ps2),
            F.when(n.isNull(), F.lit(None).cast("double")).when(empty, F.lit(0.0)).otherwise(round_half_up(comp, 4)))


def _finish(agg: DataFrame) -> DataFrame:
    scores = _shares(*[F.col(c) for c in ("n", "amp", "s", "ps", "ns", "nz")])
    return agg.select("_id", *[s.alias(c) for c, s in zip(("neg", "neu", "pos", "compound"), scores)])


def bad_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text cannot be scored (NULL text)."""
    return df.filter(F.col(text_col).isNull())


def score_distinct_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                         lex: DataFrame | None = None, **kwargs) -> DataFrame:
    """T6 for sources with many exact copies (reposts): score each distinct text once.

    Texts are keyed by ``md5``; distinct texts are scored and the scores joined
    back by hash. This moves the distinct texts through one shuffle, so it pays
    off only when copies are frequent; otherwise use :func:`score_sentiment`.
    """
    keyed = df.select(F.col(id_col), F.md5(F.col(text_col)).alias("_h"), F.col(text_col))
    distinct = keyed.select("_h", text_col).dropDuplicates(["_h"])
    scores = score_sentiment(distinct, text_col, "_h", lex, **kwargs)
    return keyed.select(id_col, "_h").join(scores, "_h", "left").drop("_h")
