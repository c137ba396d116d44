import zlib

import numpy as np
import pytest

from gaugeframe.llm import toxicity as tx
from gaugeframe.llm.common import flat


def test_pairs_count_where_single_terms_do_not():
    """Toxic only if the insult and the group are both there: no sum of single weights can tell."""
    rng = np.random.default_rng(0)
    rows, label = [], []
    for i in range(1200):
        a, b = bool(i % 2), bool(i // 2 % 2)
        rows.append(np.unique(np.concatenate([[1] * a, [2] * b, rng.integers(10, 40, 5)])).astype(np.int64))
        label.append(float(a == b))
    index, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = tx.fit(index, offsets, np.array(label), epochs=60)
    right = ((tx.sigmoid(tx.logits(model, index, offsets)) >= 0.5) == (np.array(label) > 0)).mean()
    assert right > 0.97
    flat_model = model._replace(factors=np.zeros_like(model.factors))
    assert ((tx.sigmoid(tx.logits(flat_model, index, offsets)) >= 0.5) == (np.array(label) > 0)).mean() < 0.8


def test_rare_terms_take_part_in_pairs():
    """A term in less than a hundredth of the rows turns what a usual one says into its opposite."""
    rng = np.random.default_rng(0)
    rows, label = [], []
    for i in range(24000):
        a, b = i % 120 == 0, bool(rng.integers(2))
        rows.append(np.unique(np.concatenate([[1] * a, [2] * b, rng.integers(10, 40, 5)])).astype(np.int64))
        label.append(float(a != b))
    index, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = tx.fit(index, offsets, np.array(label), epochs=40)
    right = (tx.sigmoid(tx.logits(model, index, offsets)) >= 0.5) == (np.array(label) > 0)
    assert right[::120].mean() > 0.7 and right.mean() > 0.99


def test_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = tx.Model(0.3, rng.normal(size=1 << tx.BITS), rng.normal(size=(1 << tx.BITS, tx.FACTORS)))
    index, offsets = np.array([5, 7, 900, 3], np.int64), np.array([0, 3, 3, 4])
    want = []
    for own in ([5, 7, 900], [], [3]):
        z = 0.3 + sum(model.weights[i] for i in own)
        z += sum(model.factors[i] @ model.factors[j] for n, i in enumerate(own) for j in own[n + 1 :])
        want.append(z)
    assert np.allclose(tx.logits(model, index, offsets), want)


def test_terms_ignore_case_and_marks():
    import pyarrow as pa

    index, offsets = tx.terms(*flat(pa.array(["Idiot!! the IDIOT", "idiot the", "", "é"])))
    own = [set(index[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert own[0] == own[1] and len(own[0]) == 2 and not own[2] and len(own[3]) == 1


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    return read("documents"), read("labels")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = tx.learn(docs, labels, "doc_id", "text", "toxic")
    scored = tx.score(docs, model, "doc_id", "text").join(labels, "doc_id").where(tx.held_out("doc_id")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in scored)
    caught = [r.score >= 0.5 for r in scored if r.toxic]
    blamed = [r.score >= 0.5 for r in scored if not r.toxic]
    print(len(caught), np.mean(caught), len(blamed), np.mean(blamed))
    assert np.mean(caught) > 0.6 and np.mean(blamed) < 0.01  # a tenth of the usual training rows


def test_odd_rows_and_empty_tables(spark, tables):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "y " * 100000, "d"), (3, "z", "e"), (3, "z", "e")], "doc_id bigint, text string, score string"
    )
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    model = tx.learn(docs, labels, "doc_id", "text", "toxic")
    got = tx.score(docs, model, "doc_id", "text").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    nothing = tx.learn(docs, labels.where("false"), "doc_id", "text", "toxic")
    assert all(r.score < 0.5 for r in tx.score(docs, nothing, "doc_id", "text").collect())
    assert tx.score(docs.where("false"), model, "doc_id", "text").collect() == []
    kept = tx.drop_toxic(docs, nothing, "text")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
