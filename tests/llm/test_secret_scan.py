import random
import re

import numpy as np
import pytest

from marketmood.llm import secret_scan as S

KEY = "".join(random.Random(3).choices(S.ALPHABETS[3], k=40))


def brute(text):
    """The base rules as the contract states them."""
    text = text or ""
    out = []
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def table(docs):
    return S.train(docs, sample_rows=500)


def test_base_spans_on_all_documents(docs):
    texts = [r["text"] for r in docs.collect()]
    assert sum(map(len, map(brute, texts))) > 0
    assert all(S.base_spans(t) == brute(t) for t in texts)


def test_base_spans_on_random_strings():
    rng = random.Random(8)
    parts = ["token", "TOKEN", "ſecret", "password", "api_key", "=", ":", " ", "'", '"', "abc", "0" * 23, "f" * 24, "AKIA",
             "AKIA" + "Z" * 16, "é", "-", ".", "a1", "x" * 20, "K"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert S.base_spans(text) == brute(text), text


def test_markov_tells_random_from_ordinary(table):
    rng = random.Random(5)
    hits = [S.ratio("".join(rng.choices(a, k=32)), table) >= S.MIN_RATIO for a in S.ALPHABETS for _ in range(100)]
    assert np.mean(hits) > 0.99
    for word in ("internationalization_of_everything", "getUserAccountBalanceByIdentifier", "thisIsAVeryLongIdentifierName"):
        assert S.ratio(word, table) < S.MIN_RATIO


def test_added_spans_keep_the_base(table):
    text = f"the key {KEY} and token = {KEY} or password=abc"
    base, spans = S.base_spans(text), S.all_spans(text, table)
    assert set(base) <= set(spans)
    assert [(k, text[a:b]) for a, k, b in spans] == [(3, KEY), (0, f"token = {KEY}")]
    assert S.all_spans(f"ä{KEY}", table) == []  # part of a word in another script
    assert S.redact_text(text, table) == "the key [SECRET] and [SECRET] or password=abc"
    assert S.redact_text("token=0123456789abcdef0123456789abcdef!", table) == "[SECRET]!"
    assert S.redact_text("nothing", table) is None and S.redact_text(None, table) is None


def test_clean_documents_get_no_extra_span(docs, table):
    extra = [s for r in docs.collect() for s in S.all_spans(r["text"], table) if s[1] == 3]
    assert len(extra) <= 2


def test_pair_counts():
    counts = np.zeros((S.SIZE, S.SIZE), np.int64)
    S.count_pairs(["ab", "b"], counts)
    a, b, e = S.CODE["a"], S.CODE["b"], S.EDGE
    assert counts.sum() == 5 and counts[e, a] == counts[a, b] == counts[e, b] == 1 and counts[b, e] == 2


def test_query_and_edge_cases(spark, edge_docs, no_docs):
    from marketmood.llm.queries import QUERIES
    import hashlib
    SF001 = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op1_secret_scan"](spark, SF001).collect()}
    for r in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        base, got = brute(r["text"]), rows[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(S.told(base).encode()).hexdigest()
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
    out = S.redact_secrets(edge_docs.selectExpr("*", f"'token={KEY}' AS other"))
    assert out.columns == [*edge_docs.columns, "other"] and out.count() == edge_docs.count()
    mixed = spark.createDataFrame([(1, f"a token={KEY}", 99), (2, None, 5), (3, "", None)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.redact_secrets(mixed).collect()}
    assert got == {1: ("a [SECRET]", 10), 2: (None, 5), 3: ("", None)}
    assert S.redact_secrets(mixed).schema["n_chars"].dataType == mixed.schema["n_chars"].dataType
    assert S.redact_secrets(no_docs).count() == 0


def test_keys_joined_to_ordinary_characters(table):
    rng = random.Random(9)
    before = ("session_id=", "/static/assets/images/", "/users/profile/account/sessions/", "the_quite_long_identifier_of_some_person_=")
    for n, least in ((20, 0.85), (32, 0.98)):
        for alphabet in S.ALPHABETS[1:]:
            keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(50)]
            texts = [(k, f"see {before[i % 4]}{k}{('', '/index/of/everything')[i % 2]} there") for i, k in enumerate(keys)]
            hits = [any(a <= t.index(k) and t.index(k) + n <= b for a, _, b in S.all_spans(t, table)) for k, t in texts]
            whole = [any(a < t.index(k) + n and t.index(k) < b for a, _, b in S.all_spans(t, table)) for k, t in texts]
            assert np.mean(whole) >= least, (n, alphabet, np.mean(whole))
            assert alphabet.endswith("/") or np.mean(hits) >= least, (n, alphabet, np.mean(hits))


def test_keys_beside_other_scripts_and_base_spans(table):
    found = lambda t: [t[a:b] for a, k, b in S.all_spans(t, table) if k == 3]
    assert found(f"密钥{KEY}是") == [KEY] and found(f"Schlüssel-{KEY}") == [KEY]
    assert found(f"{KEY}ä") == []  # part of a word in another script
    assert found(f"{KEY}/{'0123456789abcdef' * 2}/x")[0].startswith(KEY)
    for word in ("thequitelongidentifierofeverything/and/of/all/the/rest", "getUserAccountBalanceByIdentifier", "SELECT_ALL_FROM_TABLE_WHERE_NAME"):
        assert found(word) == []


def test_stretches_in_blocks(table, monkeypatch):
    text = f"the_user_of_all_{KEY}/and/all/the/rest/of/it/is/here/{KEY}/and/all/the/rest"
    want = list(S.stretches(text, table))
    assert len(want) == 2
    monkeypatch.setattr(S, "BLOCK", 7)
    assert list(S.stretches(text, table)) == want


ORDINARY = ["=" * 30, "-" * 40, "_" * 32, "A" * 25, "AbstractSingletonProxyFactoryBeanRegistry", "MAX_HTTP_CONNECTION_POOL_SIZE_BYTES",
            "XMLHttpRequestEventTargetPrototype", "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch",
            "DONAUDAMPFSCHIFFFAHRTSGESELLSCHAFTSKAPITAEN", "wspolczesno-przedsiebiorczy-nieprawdopodobny", "Taumatawhakatangihangakoauauotamatea",
            "550e8400-e29b-41d4-a716-446655440000", "2024-01-01-12-00-00-000000123", "12345678901234567890123",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "NSManagedObjectContextDidSaveNotification", "PTHREAD_MUTEX_INITIALIZER_RECURSIVE_NP",
            "x86_64-unknown-linux-gnu-toolchain", "/usr/share/applications/gnome-terminal/preferences", "=-" * 20, "+/" * 20]


def test_ordinary_strings_get_no_span(table):
    for word in ORDINARY:
        assert S.all_spans(f"see {word} here", table) == [], word


def test_precision_and_recall_on_words_not_trained_on(docs, monkeypatch):
    """The models learn every other listed word; identifiers are made of the rest."""
    words = S.PROGRAM_WORDS + S.LANGUAGE_WORDS
    monkeypatch.setattr(S, "PROGRAM_WORDS", words[::2])
    monkeypatch.setattr(S, "LANGUAGE_WORDS", [])
    half = S.train(docs, sample_rows=500)
    other = [w for w in S.identifiers(words[1::2], 3000, seed=5)[:3000] if len(w) >= 20]
    wrong = [w for w in other if S.all_spans(w, half)]
    assert len(wrong) <= 0.01 * len(other), wrong
    rng = random.Random(21)
    for n, least in ((16, 0.85), (20, 0.93), (32, 0.99)):
        keys = ["".join(rng.choices(a, k=n)) for a in S.ALPHABETS[1:] for _ in range(150)]
        texts = [f"see /static/{rng.choice(other)}/{k} here" for k in keys]
        assert np.mean([any(a < t.index(k) + n and t.index(k) < b for a, _, b in S.all_spans(t, half)) for k, t in zip(keys, texts)]) >= least
