import hashlib

import numpy as np
import pytest

from gaugeframe.llm import exact_dedup as ed

ROWS = [
    (1, "a b\tc"),
    (2, "abc"),
    (3, "a b c d"),
    (4, "  a b c  "),
    (None, "abc"),
    (None, "  a b c  "),
    (5, None),
    (6, ""),
    (7, " \n"),
    (8, "é x" * 50000),
    (9, "éx" * 50000),
    (10, "é\u00a0x"),
    (10, "é\u00a0x"),
    (11, "same"),
    (11, "same"),
]


def brute(rows):
    groups = {}
    for i, (key, text) in enumerate(rows):
        body = "".join(c for c in text or "" if c not in "\t\n\x0b\x0c\r ")
        groups.setdefault(body, []).append((-len(text or ""), key is None, key or 0, i, key))
    out = []
    for body, own in groups.items():
        best = min(own)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[4], best[4], len(own), m == best, sha) for m in own]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fields", [ed.FIELDS, ((3, 2),)])
@pytest.mark.parametrize("chunk", [ed.CHUNK, 5])
def test_against_brute_force(spark, fields, chunk):
    """With a modulus of 3 most fingerprints collide, so the comparison decides."""
    rows = ROWS if chunk > 5 else [(k, t if t is None else t[:40]) for k, t in ROWS]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, sha string, n int").coalesce(1)
    got = ed.exact_classes(docs, "doc_id", "text", chunk, fields).drop("__rid")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_kept_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in ROWS], "doc_id bigint, text string, n int").coalesce(1)
    assert ed.drop_copies(docs, "doc_id", "text").count() == len({b[4] for b in brute(ROWS)})
    empty = docs.where("false")
    assert ed.exact_classes(empty, "doc_id", "text").collect() == []


def test_chunk_hashes_compose():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    for chunk in (1, 7, 4999, 10000):
        got = ed.fingerprints(data, np.array([0, 3000, 3000, 5000]), chunk)
        for (modulus, base), values in zip(ed.FIELDS, got):
            for (a, b), value in zip([(0, 3000), (3000, 3000), (3000, 5000)], values):
                want = 0
                for byte in data[a:b]:
                    want = (want * base + int(byte) + 1) % modulus
                assert value == want
