import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeframe.llm import common, near_dedup, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Hello, World. it's 42 <|endoftext|>x <|ENDOFTEXT|> Ünïcödé, H\u0331 I\u0307."),
    (2, None),
    (3, ""),
    (4, "a, b. c.. d.,e \x1c f\u00a0g\u2028h \x85i"),
    (4, "a, b. c.. d.,e \x1c f\u00a0g\u2028h \x85i"),
    (None, "no id here"),
    (5, "word " * 5000),
    (6, "x" * 30000),
    (7, "...,"),
    (8, "\n \t"),
]


def expected(rows, capacity):
    coder = Tokenizer.from_file(PATH)
    out = []
    for key, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        for number, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((key, number, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def check(df, rows, capacity):
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == expected(rows, capacity)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id bigint, text string, piece string, length int")
    check(packing.pack(docs, "doc_id", "text", PATH, capacity), ODD, capacity)


def test_whole_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins, tokens = check(packing.pack(docs, "doc_id", "text", PATH), rows, 2048)
    assert bins <= -(-tokens // 2048) + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs, "doc_id", "text", PATH).collect() == []


def test_buckets_do_not_change_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 7)
    rows = [(i, "one two three" if i % 3 else "four " * (i % 11)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(packing.pack(docs, "doc_id", "text", PATH, 10), rows, 10)


def test_fullest_is_exact():
    def brute(counts, target):
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= target}
        return max(sums)

    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(2, 60, 6)}
        target = int(rng.integers(1, 150))
        got = packing.fullest(counts, target)
        assert all(m <= counts[n] for n, m in got)
        assert sum(n * m for n, m in got) == brute(counts, target)


def test_other_work_frees_the_encoder():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([7]), pa.array([b"one two three"])], names=["rid", "id", "text"])
    coder = packing.encoder(PATH)
    list(common.slices(iter([batch]), "text", uses=PATH))
    assert packing.encoder(PATH) is coder
    list(near_dedup._sign(3, 50)(iter([batch])))
    assert PATH not in common.HELD
