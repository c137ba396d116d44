import pytest

from gaugeframe.llm import url_filter as uf

RULES = [
    ("com", "/", "allow"),
    ("Example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es", "block"),
    ("net", "", "allow"),
    ("", "", "allow"),
    (None, "/x", "block"),
    ("twice.org", "/", "allow"),
    ("twice.org", "/", "block"),
]
URLS = [
    "http://a.com/x", "http://a.com", "https://EXAMPLE.com/en/", "https://sub.example.com/en/1?x=/#", "http://notexample.com/en/",
    "http://www.example.com/en/#a", "http://x.www.example.com/en", "ftp://b.net/espresso", "b.net/es", None, "", "://", "http:///x",
    "http://user@h.com:80/x", "http://b.net?u=http://c.com/", "http://É.com/É", "http://twice.org/", "http://a..com/" + "p" * 100000,
    "http://com/", "http://.com/", "x://y://z.com/q",
]


def brute(url):
    _, mark, rest = (url or "").partition("://")
    place = rest.split("?")[0].split("#")[0] if mark else ""
    host, slash, path = place.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    rules = {}
    for h, p, v in RULES:
        key = ((h or "").lower(), p or "")
        rules[key] = max(v, rules.get(key, ""))
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    return host, path, *max(fits)[2:]


@pytest.mark.parametrize("segment", [uf.SEGMENT_RULES, 2])
def test_against_brute_force(spark, segment, monkeypatch):
    build = uf.build_index
    monkeypatch.setattr(uf, "build_index", lambda rules: build(rules, segment))
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, host string, path string")
    rules = spark.createDataFrame(RULES, uf.RULES)
    got = {r[0]: tuple(r[1:]) for r in uf.judge_urls(pages, rules, "page_id", "url").collect()}
    assert got == {i: brute(u) for i, u in enumerate([*URLS, *URLS])}


def test_null_ids_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES[:1], uf.RULES)
    assert [tuple(r) for r in uf.judge_urls(pages, rules, "page_id", "url").collect()] == [(None, "a.com", "/", "com/", "allow")]
    assert uf.judge_urls(pages.where("false"), rules, "page_id", "url").collect() == []
    none = uf.judge_urls(pages, rules.where("false"), "page_id", "url", "block").collect()
    assert [tuple(r)[3:] for r in none] == [(None, "block")]


def test_equal_digests_need_equal_strings(spark, monkeypatch):
    """With one digest for everything only the stored strings decide."""
    import numpy as np

    class Same(uf.Segment):
        def __init__(self, entries):
            self.digests = np.zeros(len(entries), np.int64)
            raw = [e.encode() for e in entries]
            self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            self.strings = np.frombuffer(b"".join(raw), np.uint8)

    found = Same(["a\x00/\x00allow", "b\x00/\x00block"]).probe(np.zeros(3, np.int64), [b"b\x00/", b"c\x00/", b"a\x00/"])
    assert found == {0: "block", 2: "allow"}


def test_segments_stay_off_the_driver(spark):
    """A segment handed to the context would be copied to the driver and served from there."""
    before = set(spark.sparkContext.listFiles)
    rules = spark.createDataFrame([("example.com", "/", "block")], uf.RULES)
    pages = spark.createDataFrame([(1, "http://www.example.com/x"), (2, "http://example.org/")], "page_id bigint, url string")
    got = uf.judge_urls(pages, rules, "page_id", "url")
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == [(1, "block"), (2, "allow")]
    assert set(spark.sparkContext.listFiles) == before
