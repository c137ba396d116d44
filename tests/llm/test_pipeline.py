"""Every stage of the pipeline against a brute-force version of its own input."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gaugeframe.llm import toxicity
from gaugeframe.llm.common import flat

from .test_exact_dedup import brute as exact_brute
from .test_near_dedup import brute as near_brute
from .test_packing import check as check_packing
from .test_secret_scan import brute as secret_brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that go into each stage, and those of the last."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(9001, None, "en", "x", None), (9002, "", "en", "x", 0), (9003, "token=abcdefgh " * 3, None, None, 5), (9004, "w " * 40000, "en", "x", 1),
           (9005, "password: hunter22 " + "you are an idiot and a moron, worthless trash, pathetic loser scum", "en", "x", 9)]
    docs = docs.select(*COLUMNS).union(spark.createDataFrame(odd, docs.select(*COLUMNS).schema))
    out = []
    for number, (_, stage) in enumerate([("input", lambda s, d, f: d), *corpus_pipeline.STAGES]):
        stage(spark, docs, FOLDER).write.parquet(str(base / str(number)))
        docs = spark.read.parquet(str(base / str(number)))
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).orderBy("doc_id").collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secret scan", "packing"]
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_toxicity(spark, steps):
    raw, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(raw, labels, "doc_id", "text", "toxic")
    before = rows(steps[0])
    z = toxicity.logits(model, *toxicity.terms(*flat(pa.array([t or "" for _, t, *_ in before]))))
    assert rows(steps[1]) == [r for r, bad in zip(before, toxicity.sigmoid(z) >= 0.5) if not bad]


def test_exact_dedup(steps):
    before = rows(steps[1])
    kept = {r[0] for r in exact_brute([(r[0], r[1]) for r in before]) if r[3]}
    assert rows(steps[2]) == [r for r in before if r[0] in kept]


def test_near_dedup(steps):
    before = rows(steps[2])
    kept = {r[0] for r in near_brute([(r[0], r[1]) for r in before], 5, 80) if r[3]}
    assert rows(steps[3]) == [r for r in before if r[0] in kept]


def test_secret_scan(steps):
    want = []
    for key, text, lang, source, chars in rows(steps[3]):
        clean, at = "", 0
        for start, _, end in secret_brute(text):
            if start >= at:
                clean += text[at:start] + "[SECRET]"
            at = max(at, end)
        new = None if text is None else clean + text[at:]
        want.append((key, new, lang, source, chars if text is None else len(new)))
    assert rows(steps[4]) == want


def test_packing(steps):
    check_packing(steps[5], [(r[0], r[1]) for r in rows(steps[4])], 2048)


def test_run_does_all_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == steps[-1].columns and got.count() > 0
    assert np.isin([r.doc_id for r in got.select("doc_id").distinct().collect()], [r[0] for r in rows(steps[0])]).all()
