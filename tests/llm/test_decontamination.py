import random
import re

import numpy as np
import pytest

from gaugeframe.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window):
    out = []
    for text in texts:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            w = words(item)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == w[i : i + size]:
                        hit.update(range(j, j + size))
                        names.add(name)
        spans = [x for i in sorted(hit) if i - 1 not in hit for x in (i, next(j for j in range(i, len(own) + 1) if j not in hit))]
        out.append((len(own), spans, sorted(str(n) for n in names if n is not None)))
    return out


def made(seed, window):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "the", "ä", "x1", "9", "日本", "long" * 20]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n)) + draw.choice([".", "\n", "", "-"])
    items = [(i, text(draw.randrange(0, 3 * window))) for i in range(25)] + [(None, "zz yy"), (3, None), (7, ""), (7, ""), (99, "?!")]
    texts = [None, "", "...", "one zz yy two", "zz-YY", "zz yyy", *(text(draw.randrange(0, 60)) for _ in range(60))]
    for _ in range(20):
        texts.append(text(5) + " " + draw.choice(items)[1].__str__() + " " + text(5))
    return texts, items


def found(spark, texts, items, window, **more):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, rid string").repartition(4)
    marks = spark.createDataFrame(items, "item_id int, text string")
    got = dc.benchmark_hits(docs, "doc_id", "text", marks, "item_id", "text", window, **more).collect()
    assert len(got) == len(texts)
    return {r.doc_id: (r.n_words, [x for s in r.spans for x in s], list(r["items"])) for r in got}


@pytest.mark.parametrize("window,block", [(3, 1 << 20), (2, 300), (10, 1 << 20)])
def test_equals_brute_force(spark, window, block):
    texts, items = made(window, window)
    got = found(spark, texts, items, window, block_bytes=block)
    for i, row in enumerate(brute(texts, items, window)):
        assert got[i] == row, (i, texts[i])


def test_suffix_order():
    draw = random.Random(3)
    for high, n in ((1, 50), (2, 200), (5, 300)):
        row = np.array([0 if draw.random() < 0.1 else draw.randint(1, high) for _ in range(n)] + [0])
        order = dc.suffix_order(row, high, n).tolist()
        tail = lambda p: row[p : p + row[p:].tolist().index(0)].tolist()
        assert sorted(order) == np.flatnonzero(row).tolist()
        assert [tail(p) for p in order] == sorted(tail(p) for p in order)


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "hashes_of", lambda data, a, b: np.zeros(len(a), np.uint64))
    bank = dc.Words([b"one", b"two", b"three"])
    data = np.frombuffer(b"twoonesixthree", np.uint8)
    assert bank.numbers(data, np.array([0, 3, 6, 9]), np.array([3, 6, 9, 14])).tolist() == [3, 1, 0, 2]


def test_longest_matches(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([("b", "zero one two three four x"), ("a", "y two three four five six z"), ("c", None)], "name string, text string")
    got = dc.longest_matches(docs, "name", "text", spark.createDataFrame([(5, item)], "k int, t string"), "k", "t", least=2)
    rows = {(r.item_word): (r.item_id, r.n_words, r["name"], r.word) for r in got.collect()}
    assert rows == {0: ("5", 4, "b", 1), 1: ("5", 5, "a", 1), 2: ("5", 4, "a", 2), 3: ("5", 3, "a", 3), 4: ("5", 2, "a", 4)}


def test_drop_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "p q r", 5), (1, "p q r", 5), (2, "clean", 6), (None, None, None)], "rid int, text string, rid_ int")
    left = dc.drop_contaminated(docs, "text", spark.createDataFrame([(1, "Q r")], "k int, t string"), "k", "t")
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=repr) == [(2, "clean", 6), (None, None, None)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [tuple(r) for r in dc.benchmark_hits(docs, "doc_id", "text", none, "item_id", "text").collect()] == [(1, 2, [], [])]
    assert dc.benchmark_hits(docs.limit(0), "doc_id", "text", none, "item_id", "text").collect() == []
