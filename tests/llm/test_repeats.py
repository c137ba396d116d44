import hashlib
import random

import numpy as np
import pytest

from gaugeframe.llm import repeats


def brute(rows, window):
    """Rows of (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for key, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((key, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(docs, **more):
    got = repeats.repeated_spans(docs, "doc_id", "text", **more)
    for r in got.collect():
        ends = list(zip(r.spans[::2], r.spans[1::2]))
        assert len(ends) == r.n_spans and sum(b - a for a, b in ends) == r.n_removed
    return sorted((tuple(r) for r in got.drop("spans").collect()), key=repr)


def mixed(seed, n, letters):
    """Texts that share pieces at all offsets, overlap themselves and hold copies."""
    rng = np.random.default_rng(seed)
    word = lambda size: "".join(rng.choice(list(letters), size))
    shared = [word(int(rng.integers(20, 300))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 6))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, len(s)))
            parts += [word(int(rng.integers(0, 80))), s[a : a + int(rng.integers(1, 300))]]
        rows.append((i, "".join(parts)))
    rows += [(n + i, t) for i, (_, t) in enumerate(rows[:3])] + [(None, rows[5][1]), (n + 9, None), (n + 10, ""), (n + 11, "ab" * 300), (n + 12, "x" * 700)]
    return [*rows, rows[7]]


@pytest.mark.parametrize("most", [repeats.MOST_PASSAGES, 1])
@pytest.mark.parametrize("seed,letters,window", [(1, "abcdefghij é", 50), (2, "ab", 30), (3, "abcdefgh", 200)])
def test_against_brute_force(spark, seed, letters, window, most, monkeypatch):
    rows = mixed(seed, 60, letters)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, span int, h1 string").repartition(3)
    assert result(docs, window=window, most_passages=most) == brute(rows, window)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], 200)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_blocks_do_not_matter(monkeypatch):
    """Windows are dealt alike however a long text is cut into blocks."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)

    def windows(block):
        monkeypatch.setattr(repeats, "BLOCK", block)
        out = {}
        for a, b in repeats.blocks_of(len(data), 60):
            key, _, first, count, place = repeats.anchors(data[a:b], 60, 12)
            for k, f, c, p in zip(key, first, count, place):
                out |= {int(f + a + i): (int(k), int(p + a)) for i in range(c)}
        return out

    whole = windows(1 << 20)
    assert sorted(whole) == list(range(5000 - 60 + 1))
    assert windows(700) == whole


def test_index_finds_repeats():
    rng = np.random.default_rng(7)
    for _ in range(60):
        texts = [rng.integers(0, 3, int(rng.integers(1, 60))).astype(np.uint8) for _ in range(int(rng.integers(1, 8)))]
        texts += [texts[0].copy()]
        window = int(rng.integers(1, 12))
        count = {}
        for t in texts:
            for i in range(len(t) - window + 1):
                count[t[i : i + window].tobytes()] = count.get(t[i : i + window].tobytes(), 0) + 1
        want = [[i for i in range(len(t) - window + 1) if count[t[i : i + window].tobytes()] > 1] for t in texts]
        assert [list(x) for x in repeats.repeated_windows(texts, window)] == want


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order_is_that_of_the_strings(seed):
    draw = random.Random(seed)
    parts = [[draw.randint(1, 2 + seed % 3) for _ in range(draw.randrange(0, 60))] for _ in range(draw.randrange(1, 8))] + [[1] * 30]
    parts += parts[:2]
    symbols = np.array([x for p in parts for x in (*p, 0)])
    left = np.array([len(p) - i for p in parts for i in range(len(p) + 1)])
    want = sorted(range(len(symbols)), key=lambda i: (symbols[i : i + left[i]].tolist(), i))
    assert repeats.suffix_order(symbols, left).tolist() == want
