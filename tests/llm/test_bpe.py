import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", " \n ", "a  b", "a\n\nb", "a \n b", "\ta", "a\t\tb \t", "it's we'll 'S don't  's", "x'llama", "123abc 4 5", "é ü ß 漢字 😀👍🏽",
    "a b   c", "a  b", "　 x", "a\x85 b", "\x1c\x1d a", "<|endoftext|>", " <|endoftext|> ", "a <|endoftext|>b<|endoftext|><|endoftext|>",
    "x  <|endoftext|>  y", "<|endoftext|", "aaaaaaaaaaaaaaaaaaaaa", "!!!???...", "http://a.b/c?d=e&f", "\x00\x01\x7f", "ȩ́", "a" * 9000,
    " " * 5000 + "x", "\n" * 3000, "ab" * 4000,
]


def own(texts):
    coder = bpe.Bpe(PATH)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    data, ends = coder.decode(ids)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])], [data[ends[a] : ends[b]].tobytes().decode() for a, b in zip(at[:-1], at[1:])]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    ids, texts = own(ODD)
    for text, a, b in zip(ODD, ids, library(ODD)):
        assert a == b, repr(text[:50])
    assert texts == ODD


def test_random_texts():
    rng = np.random.default_rng(3)
    letters = list("abcdeinrst  \n\t'.,!0129éß漢  AB_-") + ["the", "ing", " of", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 200)))) for _ in range(400)]
    texts += ["".join(map(chr, rng.integers(33, 127, 5000)))]
    ids, back = own(texts)
    assert ids == library(texts)
    assert back == texts


@pytest.mark.parametrize("long_word", [1, 64])
def test_long_words_run_alone(monkeypatch, long_word):
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    ids, _ = own(ODD)
    assert ids == library(ODD)


def test_spark_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "y"), (1, "twice", "z"), (1, "twice", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = bpe.encode_texts(docs, "doc_id", "text", PATH)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode_ids(coded, PATH).collect()), key=repr)
    want = [(i, len(x), np.array(x, "<u4").tobytes(), t or "") for (i, t, _), x in zip(rows, library([t or "" for _, t, _ in rows]))]
    assert got == sorted(want, key=repr)
    assert bpe.encode_texts(docs.where("false"), "doc_id", "text", PATH).collect() == []


def test_bytes_that_are_not_text(spark):
    coded = spark.createDataFrame([(1, bytearray(np.array([0, 50256, 226], "<u4").tobytes())), (2, None)], "doc_id bigint, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode_ids(coded, PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).decode([0, 50256, 226], skip_special_tokens=False), 2: None}


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = sorted(bpe.encode_texts(docs, "doc_id", "text", PATH).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == library([r.text for r in rows])


def test_remembered_units_are_bounded_by_bytes():
    from gaugeframe.llm.common import LONGEST_UNIT, UNIT_COST, Known

    known = Known(50 * (UNIT_COST + 20))
    work_out = lambda units: (np.array([len(u) for u in units]), np.concatenate([np.frombuffer(u, np.uint8) for u in units]).astype(np.uint32))
    for turn in range(20):
        units = [b"u%d-%d" % (turn, i) for i in range(9)] + [b"long%d" % turn * LONGEST_UNIT, b"again"]
        starts, sizes, pool = known.look_up(units, work_out)
        assert [bytes(pool[a : a + n].astype(np.uint8)) for a, n in zip(starts, sizes)] == units
    assert known.held <= known.most and all(len(u) <= LONGEST_UNIT for u in known.place) and len(known.pool) < known.most
