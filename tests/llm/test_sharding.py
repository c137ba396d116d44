import hashlib

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import sharding


def bits(text):
    return bin(int(hashlib.md5(text.encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute(rows, limit):
    """Split by the bits of id and text only; rows that stay together are not expected here."""
    out, todo = [], [("", [(bits("" if k is None else str(k)) + bits(t or ""), k, len((t or "").encode())) for k, t in rows])]
    while todo:
        prefix, own = todo.pop()
        total = sum(n for _, _, n in own)
        if total <= limit or len(own) == 1:
            out += [(k, n, prefix, len(prefix), total, len(own)) for _, k, n in own]
        else:
            todo += [(prefix + b, part) for b in "01" if (part := [r for r in own if r[0][len(prefix)] == b])]
    return sorted(out, key=repr)


ROWS = [(i, "x" * (i * 37 % 200)) for i in range(500)] + [(None, "nameless"), (7, None), (1000, "y" * 5000)] + [(2000, f"text {i}") for i in range(40)]


@pytest.mark.parametrize("limit", [1 << 30, 5000, 300, 60])
@pytest.mark.parametrize("step", [16, 3])
def test_against_brute_force(spark, limit, step, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", step)
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, shard string")
    if step == 3 and limit < 300:
        return  # some forty rounds
    got = sharding.assign_shards(docs, "doc_id", "text", limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS, limit)


def test_equal_rows_are_split_by_their_number(spark):
    docs = spark.createDataFrame([(1, "same text")] * 64, "doc_id bigint, text string").coalesce(1)
    got = sharding.assign_shards(docs, "doc_id", "text", 40)
    assert got.count() == 64
    assert all(r.shard_bytes <= 40 and r.shard_rows <= 4 for r in got.collect())


def test_directory_and_files(spark, tmp_path):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None and r[0] < 500 and r[1] is not None], "doc_id bigint, text string")
    shards = sharding.assign_shards(docs, "doc_id", "text", 5000)
    entries = sorted(sharding.directory(shards).collect(), key=lambda r: r["first"])
    width = len(entries[0]["first"])
    ranges = [(int(r["first"], 2), int(r["last"], 2)) for r in entries]
    assert all(b[0] > a[1] for a, b in zip(ranges, ranges[1:])) and ranges[-1][1] < 1 << width
    sharding.write_shards(docs, shards, "doc_id", str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.groupBy("__shard").agg(F.sum(F.octet_length("text")).alias("n")).where("n > 5000").count() == 0
    assert back.count() == docs.count()


def test_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", 10).collect() == []
