"""DuckDB SQL building blocks for the correctness oracle.

Only the views the driver registers are used (``orders``, ``documents``,
``pages`` ...). Fixture views and the sentiment scorer are re-stated here in
plain SQL so the oracle shares no code path with the Spark plans.
"""

from __future__ import annotations

from marketmood.operators import sentiment as S
from marketmood.sources.fixtures import DEMO_LEMMAS, DEMO_LEXICON, POSTS_SQL, PRICES_SQL, sql_values
from marketmood.functions.text import STOP_WORDS


def dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    """Engine-neutral half-up rounding (same formula as ``round_half_up``)."""
    scale = float(10 ** digits)
    return f"(floor(({expr}) * {scale!r} + 0.5) / {scale!r})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


PUNCT = S.PUNCT_CLASS.replace("\\\\", "\\")
WS = "[\\t\\n\\x0B\\f\\r ]+"


def _booster_case(p: str) -> str:
    whens = " ".join(f"WHEN {q(w)} THEN {dbl(v)}" for w, v in S.BOOSTERS.items())
    return f"coalesce(CASE lower({p}) {whens} END, {dbl(0.0)})"


def sentiment_ctes(src: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                   out: str = "scores", lex: str = "lex", phrases: str | None = None) -> str:
    """CTEs ending in ``{out}(id, neg, neu, pos, compound)``; ``phrases`` names a table ``(phrase, valence)``."""
    strip = f"regexp_replace(t, '^{PUNCT}+|{PUNCT}+$', '', 'g')"
    neg_words = in_list(S.NEGATIONS)
    parts = [f"""
sd AS (
  SELECT {id_col} AS id, {text_col} AS text,
         list_transform(list_filter(regexp_split_to_array({text_col}, '{WS}'), lambda t: t <> ''),
                        lambda t: CASE WHEN length({strip}) <= 2 THEN t ELSE {strip} END) AS toks
  FROM {src}),
sp AS (
  SELECT id, toks, CAST(len(toks) AS BIGINT) AS n,
         len(list_filter(toks, lambda x: upper(x) = x AND lower(x) <> x)) AS ncaps,
         coalesce(list_position(list_transform(toks, lambda x: lower(x)), 'but'), 0) - 1 AS bi,
         CAST(least(length(text) - length(replace(text, '!', '')), 4) AS DOUBLE) * {dbl(S.EXCL_STEP)}
         + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {dbl(S.QM_MAX)}
                WHEN length(text) - length(replace(text, '?', '')) > 1
                THEN CAST(length(text) - length(replace(text, '?', '')) AS DOUBLE) * {dbl(S.QM_STEP)}
                ELSE {dbl(0.0)} END AS amp
  FROM sd),
si AS (SELECT id, n, ncaps, bi, unnest(toks) AS tok, unnest(range(0, len(toks))) AS i FROM sp),
sw AS (
  SELECT *, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3,
         lead(tok, 1) OVER w AS nx, lead(tok, 2) OVER w AS n2
  FROM si WINDOW w AS (PARTITION BY id ORDER BY i)),
sh AS (
  SELECT sw.*, l.valence AS val, k1.token AS k1, k2.token AS k2, k3.token AS k3,
         (ncaps > 0 AND ncaps < n) AS capdiff
  FROM sw JOIN {lex} l ON lower(sw.tok) = l.token
       LEFT JOIN {lex} k1 ON lower(sw.p1) = k1.token
       LEFT JOIN {lex} k2 ON lower(sw.p2) = k2.token
       LEFT JOIN {lex} k3 ON lower(sw.p3) = k3.token
  WHERE lower(sw.tok) NOT IN {in_list(S.BOOSTERS)}
    AND NOT (lower(sw.tok) = 'kind' AND lower(coalesce(sw.nx, '')) = 'of')),
v0 AS (
  SELECT * REPLACE (CASE WHEN upper(tok) = tok AND lower(tok) <> tok AND capdiff
                         THEN CASE WHEN val > 0 THEN val + {dbl(S.C_INCR)} ELSE val - {dbl(S.C_INCR)} END
                         ELSE val END AS val)
  FROM sh)"""]
    prev = "v0"
    for d, damp in zip((1, 2, 3), S.DISTANCE_DAMPING):
        p, k = f"p{d}", f"k{d}"
        b = _booster_case(p)
        applies = f"({p} IS NOT NULL AND {k} IS NULL)"
        scalar = (f"CASE WHEN {b} <> 0 THEN (CASE WHEN val < 0 THEN -{b} ELSE {b} END) + "
                  f"(CASE WHEN upper({p}) = {p} AND lower({p}) <> {p} AND capdiff "
                  f"THEN (CASE WHEN val > 0 THEN {dbl(S.C_INCR)} ELSE {dbl(-S.C_INCR)} END) ELSE {dbl(0.0)} END) "
                  f"ELSE {dbl(0.0)} END")
        special = ""
        if phrases and d > 1:
            so = " OR ".join(f"lower(p{k}) IN ('so', 'this')" for k in range(1, d))
            doubt = " OR ".join(f"lower(p{k}) = 'doubt'" for k in range(1, d))
            special = (f"WHEN {applies} AND lower({p}) = 'never' AND coalesce({so}, false) THEN val * {dbl(S.NEVER_SO)} "
                       f"WHEN {applies} AND lower({p}) = 'without' AND coalesce({doubt}, false) THEN val ")
        parts.append(f"""
v{d}a AS (SELECT * REPLACE (CASE WHEN {applies} THEN val + ({scalar}) * {dbl(damp)} ELSE val END AS val) FROM {prev}),
v{d}b AS (SELECT * REPLACE (CASE {special}WHEN {applies} AND (lower({p}) IN {neg_words} OR contains(lower({p}), 'n''t'))
                           THEN val * {dbl(S.N_SCALAR)} ELSE val END AS val) FROM v{d}a)""")
        prev = f"v{d}b"
    if phrases:
        runs = ("p3 || ' ' || p2 || ' ' || p1 || ' ' || tok", "p2 || ' ' || p1 || ' ' || tok", "p1 || ' ' || tok || ' ' || nx",
                "tok || ' ' || nx || ' ' || n2", "p1 || ' ' || tok", "tok || ' ' || nx")
        found = ", ".join(f"(SELECT max(h.valence) FROM {phrases} h WHERE h.phrase = lower({run}))" for run in runs)
        parts.append(f"""
vp AS (SELECT * REPLACE (coalesce({found}, val) AS val) FROM {prev})""")
        prev = "vp"
    parts.append(f"""
vl AS (SELECT * REPLACE (CASE WHEN lower(p1) = 'least' AND k1 IS NULL
                               AND (p2 IS NULL OR lower(p2) NOT IN ('at', 'very'))
                          THEN val * {dbl(S.N_SCALAR)} ELSE val END AS val) FROM {prev}),
vb AS (SELECT id, CASE WHEN bi >= 0 AND i < bi THEN val * {dbl(S.BUT_BEFORE)}
                       WHEN bi >= 0 AND i > bi THEN val * {dbl(S.BUT_AFTER)} ELSE val END AS v FROM vl),
sg AS (SELECT id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 END) AS ps,
              sum(CASE WHEN v < 0 THEN v - 1 END) AS ns, count(CASE WHEN v <> 0 THEN 1 END) AS nz
       FROM vb GROUP BY id),
sj AS (SELECT sp.id, sp.n, sp.amp, coalesce(sg.s, 0.0) AS s, coalesce(sg.ps, 0.0) AS ps,
              coalesce(sg.ns, 0.0) AS ns, coalesce(sg.nz, 0) AS nz
       FROM sp LEFT JOIN sg ON sp.id = sg.id),
sk AS (SELECT id, n,
              CASE WHEN s > 0 THEN s + amp WHEN s < 0 THEN s - amp ELSE s END AS s2,
              CASE WHEN ps > abs(ns) THEN ps + amp ELSE ps END AS ps2,
              CASE WHEN ps < abs(ns) THEN ns - amp ELSE ns END AS ns2,
              CAST(n - nz AS DOUBLE) AS neu_n
       FROM sj),
{out} AS (
  SELECT id AS {id_col},
    CASE WHEN n IS NULL THEN NULL WHEN n = 0 THEN 0.0 ELSE {r('abs(ns2 / (ps2 + abs(ns2) + neu_n))', 3)} END AS neg,
    CASE WHEN n IS NULL THEN NULL WHEN n = 0 THEN 0.0 ELSE {r('abs(neu_n / (ps2 + abs(ns2) + neu_n))', 3)} END AS neu,
    CASE WHEN n IS NULL THEN NULL WHEN n = 0 THEN 0.0 ELSE {r('abs(ps2 / (ps2 + abs(ns2) + neu_n))', 3)} END AS pos,
    CASE WHEN n IS NULL THEN NULL WHEN n = 0 THEN 0.0
         ELSE {r(f'greatest(-1.0, least(1.0, s2 / sqrt(s2 * s2 + {dbl(S.ALPHA)})))', 4)} END AS compound
  FROM sk)""")
    return ",".join(parts)


LEX_CTE = f"lex(token, valence) AS (VALUES {sql_values(DEMO_LEXICON)})"
LEMMA_CTE = f"lemmas(form, lemma) AS (VALUES {sql_values(DEMO_LEMMAS)})"
PRICES_CTE = f"prices AS ({PRICES_SQL})"
POSTS_CTE = f"posts AS ({POSTS_SQL})"
STOP_LIST = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"

SCORED_POSTS_CTE = """scored_posts AS (
  SELECT p.post_id, p.ts, p.symbol, p.doc_id, s.compound, s.neg, s.neu, s.pos
  FROM posts p JOIN scores s ON p.doc_id = s.doc_id)"""

DAILY_CTE = """daily_sent AS (
  SELECT symbol, CAST(ts AS DATE) AS date, avg(compound) AS compound
  FROM scored_posts GROUP BY 1, 2),
daily AS (
  SELECT d.symbol, d.date, d.compound, p.open, p.close, p.high, p.low, p.volume
  FROM daily_sent d JOIN prices p ON d.symbol = p.symbol AND d.date = p.date)"""


def with_views(*names: str) -> str:
    """``WITH`` clause holding the requested fixture views (and their inputs)."""
    need = list(names)
    order = ["prices", "posts", "lex", "lemmas", "scores", "scored_posts", "daily"]
    deps = {"scores": ["lex"], "scored_posts": ["posts", "scores"], "daily": ["scored_posts", "prices"]}
    want = set()

    def add(n):
        if n in want:
            return
        want.add(n)
        for d in deps.get(n, []):
            add(d)

    for n in need:
        add(n)
    text = {"prices": PRICES_CTE, "posts": POSTS_CTE, "lex": LEX_CTE, "lemmas": LEMMA_CTE,
            "scores": None, "scored_posts": SCORED_POSTS_CTE, "daily": DAILY_CTE}
    out = []
    for n in order:
        if n in want:
            out.append(sentiment_ctes() if n == "scores" else text[n])
    return "WITH " + ",\n".join(out) + "\n" if out else ""
