"""Results must not depend on how the input files are split, also if that changes between the jobs of one operator."""

import pytest

from gaugeframe.llm import common, exact_dedup, near_dedup, secret_scan

SPLIT, OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Files of different size, whose order changes with the splits."""
    base = tmp_path_factory.mktemp("splits")
    for number in range(8):
        texts = [" ".join(f"w{number}x{i}x{j}" for j in range(10 + 20 * (number * 5 % 8))) for i in range(6)]
        secret = f" password: hunter22{number}"
        rows = [(10 * number + i, t + secret * (i == number % 6)) for i, t in enumerate(texts)] + [(1000 + number, texts[5] + " ")]
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(base / str(number)))
    return spark.read.parquet(*[str(base / str(n)) for n in range(8)])


@pytest.fixture
def moving_splits(spark, monkeypatch):
    """Each file is read by a task of its own until the first result is stored, then all by few."""
    real, before, calls = common.scratch_dir, {k: spark.conf.get(k) for k in (SPLIT, OPEN)}, []

    def scratch_dir(session, name):
        calls.append(name)
        session.conf.set(SPLIT, "64k" if len(calls) == 1 else "128m")
        session.conf.set(OPEN, "64k" if len(calls) == 1 else "4k")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        return real(session, name)

    monkeypatch.setattr(common, "scratch_dir", scratch_dir)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_exact_copies(spark, docs, moving_splits):
    got = sorted(r.doc_id for r in exact_dedup.drop_copies(docs, "doc_id", "text").collect())
    # The text with a space more stays, where its twin has no secret.
    assert got == sorted([10 * n + i for n in range(8) for i in range(6) if i < 5 or n == 5] + [1000 + n for n in range(8)])


def test_near_copies(spark, docs, moving_splits):
    got = sorted(r.doc_id for r in near_dedup.drop_near_copies(docs, "doc_id", "text").collect())
    assert got == sorted([10 * n + i for n in range(8) for i in range(6)])


def test_secrets(spark, docs, moving_splits):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.find_spans(docs, "doc_id", "text", rules)
    assert sorted(r.doc_id for r in found.where("size(found) > 0").collect()) == [10 * n + n % 6 for n in range(8)]


def test_hidden_secrets(spark, docs, moving_splits):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    got = {r.doc_id: r.text for r in secret_scan.redact(docs, "doc_id", "text", rules).collect()}
    assert len(got) == 56 and not any("hunter22" in t for t in got.values()) and sum("[SECRET]" in t for t in got.values()) == 8
