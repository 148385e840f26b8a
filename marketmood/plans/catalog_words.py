"""Registered queries of word splitting, noun lemmas and sub-word encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketmood.functions import text as TX
from marketmood.operators import text_ops as TO
from marketmood.plans import catalog_ml as CM
from marketmood.plans.catalog import register
from marketmood.session import store
from marketmood.sources import fixtures as FX
from marketmood.sources import schemas
from marketmood.sources.readers import read_text_table

# --- fixed values -----------------------------------------------------------
# Frequent words of the documents and what stands in for them, so that every splitting rule meets them.
WORD_SWAPS = [(" of ", " don't "), (" and ", " gonna "), (" to ", ' "can\'t, won\'t" '), (" is ", " wait... it's "),
              (" that ", " cannot--lemme "), (" it ", " (the u.s. dogs') "), (" was ", " we've $5,000: yes. ")]
# Irregular plurals for the noun rules.
IRREGULAR = [("ones", "unit"), ("this", "this"), ("des", "der"), ("feet", "foot")]
# Sizes of the sub-word vocabulary and the encoding.
WORDS, PIECES, LENGTH = 300, 400, 40
# --- end of fixed values ----------------------------------------------------

SWAPPED_WORDS_SQL = "text"
for _a, _b in WORD_SWAPS:
    SWAPPED_WORDS_SQL = f"replace({SWAPPED_WORDS_SQL}, '{_a}', '" + _b.replace("'", "''") + "')"


# The oracle writes the cascade out by hand.
@register("t2_treebank_tokens", r"""
WITH s AS (SELECT doc_id, '  ' || regexp_replace(lower(""" + SWAPPED_WORDS_SQL + r"""), '\s+', '  ', 'g') || '  ' AS t FROM documents),
q1 AS (SELECT doc_id, regexp_replace(t, '([ (\[{<])"', '\1 `` ', 'g') AS t FROM s),
q2 AS (SELECT doc_id, replace(replace(t, '"', ' '''' '), '''''', ' '''' ') AS t FROM q1),
q3 AS (SELECT doc_id, regexp_replace(t, '([“”„«»‘])', ' \1 ', 'g') AS t FROM q2),
s1 AS (SELECT doc_id, regexp_replace(t, '\.\.+', ' \0 ', 'g') AS t FROM q3),
s2 AS (SELECT doc_id, regexp_replace(t, '[;@#$%&?!*()<>{}]|\[|\]', ' \0 ', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(t, '--+', ' \0 ', 'g') AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(t, '([:,])([^0-9])', ' \1 \2', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, regexp_replace(t, '([^ .][^ .])\.((?:''''|[ ''”’»)\]}>])* )', '\1 .  \2', 'g') AS t FROM s4),
c1 AS (SELECT doc_id, regexp_replace(t, '([^ ''])(''(?:s|m|d|ll|re|ve)|n''t|'') ', '\1  \2 ', 'g') AS t FROM s5),
c2 AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, ' cannot ', ' can  not '),
         ' gimme ', ' gim  me '), ' lemme ', ' lem  me '), ' gonna ', ' gon  na '), ' wanna ', ' wan  na '), ' gotta ', ' got  ta '),
         ' more''n ', ' more  ''n '), ' ''tis ', ' ''t  is '), ' ''twas ', ' ''t  was ') AS t FROM c1)
SELECT doc_id, array_to_string(list_filter(string_split(t, ' '), lambda x: x <> ''), ' ') AS tokens FROM c2
""")
def t2_treebank_tokens(spark, sf_dir):
    text = F.col("text")
    for a, b in WORD_SWAPS:
        text = F.replace(text, F.lit(a), F.lit(b))
    d = read_text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", F.array_join(TX.treebank_tokens(text), " ").alias("tokens"))


NOUNS_SQL = r"""
k AS (SELECT doc_id, regexp_extract_all(lower(text), '""" + CM.TOKEN_RE + r"""') AS toks FROM documents),
forms AS (SELECT DISTINCT unnest(toks) AS form FROM k),
nouns AS (SELECT form AS word FROM forms WHERE regexp_full_match(form, '[a-z]{2,}') AND (length(form) % 3 <> 0 OR form = 'unit')),
irregular(form, lemma) AS (VALUES """ + FX.sql_values(IRREGULAR) + r"""),
cut AS (SELECT form, ending, replacement, place, substr(form, 1, length(form) - length(ending)) || replacement AS word
        FROM forms JOIN (VALUES ('s', '', 1), ('ses', 's', 2), ('ves', 'f', 3), ('xes', 'x', 4), ('zes', 'z', 5), ('ches', 'ch', 6),
                                ('shes', 'sh', 7), ('men', 'man', 8), ('ies', 'y', 9)) r(ending, replacement, place) ON ends_with(form, ending)),
cut2 AS (SELECT form, r.place AS place2, c.place, substr(word, 1, length(word) - length(r.ending)) || r.replacement AS word
         FROM cut c JOIN (VALUES ('s', '', 1), ('ses', 's', 2), ('ves', 'f', 3), ('xes', 'x', 4), ('zes', 'z', 5), ('ches', 'ch', 6),
                                 ('shes', 'sh', 7), ('men', 'man', 8), ('ies', 'y', 9)) r(ending, replacement, place) ON ends_with(word, r.ending)),
tried AS (SELECT form, 1 AS level, 0 AS place, form AS word FROM forms WHERE form NOT IN (SELECT form FROM irregular)
          UNION ALL SELECT form, 1, place, word FROM cut WHERE form NOT IN (SELECT form FROM irregular)
          UNION ALL SELECT form, 2, place * 10 + place2, word FROM cut2 WHERE form NOT IN (SELECT form FROM irregular)
          UNION ALL SELECT form, 1, 0, form FROM forms WHERE form IN (SELECT form FROM irregular)
          UNION ALL SELECT form, 1, 1, lemma FROM irregular),
found AS (SELECT form, arg_min(word, [level, length(word), place]) AS lemma FROM tried WHERE word IN (SELECT word FROM nouns) GROUP BY 1)"""


def _nouns(words):
    return (words.select(F.explode("tokens").alias("word")).distinct()
            .filter(F.col("word").rlike("^[a-z]{2,}$") & ((F.length("word") % 3 != 0) | (F.col("word") == "unit"))))


def _noun_lemmas(spark, words):
    exceptions = FX.values_table(spark, IRREGULAR, schemas.LEMMAS)
    return TO.noun_lemmas(words, _nouns(words), exceptions, "tokens")


@register("t3_noun_lemmas", "WITH " + NOUNS_SQL.strip() + "\nSELECT form, lemma FROM found JOIN forms USING (form) WHERE form <> lemma")
def t3_noun_lemmas(spark, sf_dir):
    return _noun_lemmas(spark, CM._words(spark, sf_dir))


@register("t3_noun_lemmatised", "WITH " + NOUNS_SQL.strip() + """,
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM k),
g AS (SELECT e.doc_id, string_agg(coalesce(f.lemma, e.tok), ' ' ORDER BY e.pos) AS lem FROM e LEFT JOIN found f ON e.tok = f.form GROUP BY 1)
SELECT k.doc_id, coalesce(g.lem, '') AS lemmas FROM k LEFT JOIN g ON k.doc_id = g.doc_id
""")
def t3_noun_lemmatised(spark, sf_dir):
    words = CM._words(spark, sf_dir)
    lem = TO.lemmatise(words, _noun_lemmas(spark, words), "doc_id", "tokens", "l")
    return lem.select("doc_id", F.array_join("l", " ").alias("lemmas"))


PIECE_SQL = "WITH RECURSIVE " + CM.KEPT_SQL + f""",
counts AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest(toks) AS token FROM k) GROUP BY 1),
st AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS start FROM counts),
pt AS (SELECT word, n, start, unnest(range(1, least(4, length(word) - start + 1) + 1)) AS size FROM st),
sums AS (SELECT CASE WHEN start > 1 THEN '##' ELSE '' END || substr(word, start, size) AS token, size, sum(n) AS n FROM pt GROUP BY 1, 2),
parts AS (SELECT * FROM (SELECT word AS token, n, 0 AS rank FROM counts ORDER BY n DESC, token LIMIT {WORDS})
          UNION ALL SELECT * FROM (SELECT token, n, 1 FROM sums WHERE size > 1 ORDER BY n DESC, token LIMIT {PIECES})
          UNION ALL SELECT token, n, 2 FROM sums WHERE size = 1),
once AS (SELECT token, min([rank, -n]) AS place FROM parts GROUP BY 1),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY place, token) + 3 AS BIGINT) AS id FROM once)"""


@register("t14_piece_vocab", PIECE_SQL + "\nSELECT token, id FROM v")
def t14_piece_vocab(spark, sf_dir):
    return TO.piece_vocab(CM._kept(spark, sf_dir), "tokens", WORDS, PIECES)


@register("t13_encode_pieces", PIECE_SQL + f""",
heads AS (SELECT doc_id, toks[1:{LENGTH - 2}] AS toks FROM k),
words AS (SELECT DISTINCT unnest(toks) AS word FROM heads),
s1 AS (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM words WHERE length(word) <= 100 AND word NOT LIKE '%q%'),
s2 AS (SELECT word, start, unnest(range(1, length(word) - start + 2)) AS size FROM s1),
best AS (SELECT word, start, max(size) AS size, arg_max(id, size) AS id FROM s2
         JOIN v ON v.token = CASE WHEN start > 1 THEN '##' ELSE '' END || substr(word, start, size)
         WHERE v.token NOT LIKE '%q%' GROUP BY 1, 2),
walk(word, next, ids) AS (SELECT word, CAST(1 AS BIGINT), CAST([] AS BIGINT[]) FROM words
         UNION ALL SELECT w.word, w.next + b.size, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.start = w.next),
cut AS (SELECT words.word, coalesce(ids, [CAST(1 AS BIGINT)]) AS ids FROM words
        LEFT JOIN walk ON walk.word = words.word AND next = length(words.word) + 1),
e AS (SELECT doc_id, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM heads),
g AS (SELECT doc_id, flatten(list(ids ORDER BY pos))[1:{LENGTH - 2}] AS ids FROM e JOIN cut ON e.word = cut.word GROUP BY 1),
f AS (SELECT heads.doc_id, list_concat([CAST(2 AS BIGINT)], coalesce(g.ids, []), [CAST(3 AS BIGINT)]) AS ids
      FROM heads LEFT JOIN g ON heads.doc_id = g.doc_id)
SELECT doc_id, list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: CAST(0 AS BIGINT))) AS input_ids,
       list_concat(list_transform(range(len(ids)), lambda x: CAST(1 AS BIGINT)),
                   list_transform(range({LENGTH} - len(ids)), lambda x: CAST(0 AS BIGINT))) AS attention_mask FROM f
""")
def t13_encode_pieces(spark, sf_dir):
    """Without the pieces that hold a q, so that some words can't be cut up."""
    kept = CM._kept(spark, sf_dir)
    vocab = store(TO.piece_vocab(kept, "tokens", WORDS, PIECES).filter(~F.col("token").contains("q")), "pieces")
    return TO.encode_pieces(kept, vocab, "doc_id", "tokens", LENGTH)
