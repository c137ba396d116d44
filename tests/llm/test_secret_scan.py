import re

import numpy as np
import pytest

from gaugeframe.llm import secret_scan as ss

RULES = ss.BASE_RULES + ss.MORE_RULES
CONTRACT = {
    "assign": (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def brute(text):
    """Base spans by the wording of the contract, further ones by their rule."""
    text = text or ""
    out = []
    for number, rule in enumerate(RULES):
        pattern, good = CONTRACT.get(rule.kind, (rule.pattern, lambda m: True))
        flags = re.ASCII | (re.IGNORECASE if rule.kind == "assign" else 0)
        out += [(m.start(), number, m.end()) for m in re.finditer(pattern, text, flags) if good(m)]
    return sorted(out)


TEXTS = [
    None, "", "nothing", "password: hunter22", "PassWord='abcdef' token=abc secret = x", "token=token:abcdefgh", "api_key=APIKEY=abcdefg apikey:\"zzzzzz\"",
    "AKIA" + "A" * 16, "AKIAAKIA" + "0" * 20, "AKIAX AKIA" + "B" * 40, "AKIA" + "Z" * 15, "0123456789abcdef01234567", "g" + "ab" * 11, "é😀 " + "ab" * 12 + " é secret: é",
    "deadbeef" * 3 + "G" + "deadbeef" * 4, "secret=" + "deadbeef" * 4, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY----- x", "ghp_" + "a" * 36, "ghx_" + "a" * 40,
    "ghs_" + "a" * 50 + " token=ghp_" + "b" * 40, "passwd" + " " * 2000 + "=" + "x" * 50000, "token=abcdef " * 3000, "toKen=abcdefg ſecret=abcdefg", "sec\nret=abcdef token\n=abcdef",
    "\n".join("password=pass%d word" % i for i in range(50)),
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, rid int, kinds string").coalesce(2)


def spans(df):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in df.collect()}


def test_against_python(spark):
    assert spans(ss.find_spans(docs_of(spark, TEXTS), "doc_id", "text", RULES)) == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_random_texts(spark):
    rng = np.random.default_rng(8)
    bits = ["password", "SECRET", "token", "api", "_", "key", "=", ":", " ", "'", '"', "AKIA", "ABCD1234", "abcdef", "0123456789abcdef", "\n", "é", "ghp_", "x" * 20, "-----BEGIN ", "PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 40)))) for _ in range(800)]
    assert spans(ss.find_spans(docs_of(spark, texts), "doc_id", "text", RULES)) == {i: brute(t) for i, t in enumerate(texts)}


def test_redaction(spark):
    docs = docs_of(spark, TEXTS)
    got = {r.doc_id: r.text for r in ss.redact(docs, "doc_id", "text", RULES).collect()}
    for i, text in enumerate(TEXTS):
        want, at = "", 0
        for start, _, end in brute(text):
            if start >= at:
                want += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert got[i] == (None if text is None else want + text[at:])
    assert ss.redact(docs, "doc_id", "text", RULES).columns == docs.columns


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, TEXTS[3]), (1, TEXTS[7]), (1, TEXTS[7])], "doc_id bigint, text string")
    got = ss.find_spans(docs, "doc_id", "text", RULES).collect()
    assert sorted(len(r.found) for r in got) == [1, 1, 1]
    assert ss.find_spans(docs.where("false"), "doc_id", "text", RULES).collect() == []
    assert ss.redact(docs.where("false"), "doc_id", "text", RULES).collect() == []


def test_queries_from_patterns():
    grams = lambda *s: [frozenset(s)]
    assert ss.trigram_query("AKIA[A-Z0-9]{16,}") == [grams("aki", "kia")]
    assert ss.trigram_query("[0-9a-f]{24,}") == []
    assert ss.trigram_query("abc|de") == []
    assert ss.trigram_query("abc(?:d|ef)") == [[frozenset({"abc", "bcd"}), frozenset({"abc", "bce", "cef"})]]
    assert ss.trigram_query("ab.cdef+gh") == [grams("cde")]
    assert ss.trigram_query("x?abc") == [grams("abc")]
    assert len(ss.trigram_query(ss.BASE_RULES[0].pattern)[0]) == 6


@pytest.mark.parametrize("pattern", [r.pattern for r in RULES] + ["ab[cd]e(f|g)h", "(abc)?def", "a{2,3}bc"])
def test_a_match_always_fits_its_query(pattern):
    rng = np.random.default_rng(3)
    letters = ["a", "b", "c", "d", "e", "f", "g", "h", "aa", "password", "token", "AKIA", "=", "x" * 10, "A" * 16, "0" * 24, "ghp_", "-----BEGIN PRIVATE KEY-----"]
    query = ss.trigram_query(pattern)
    for _ in range(3000):
        text = "".join(rng.choice(letters, 12))
        if re.search(pattern, text):
            low = text.lower()
            assert all(any(all(g in low for g in s) for s in clause) for clause in query)
