import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gaugeframe.llm import alignment
from gaugeframe.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Groups, links and counts, text by text, with the libraries on whole texts."""
    byte = Tokenizer.from_file(A)
    byte.encode_special_tokens = True
    piece = SentencePieceProcessor(model_file=B)
    letters = byte_letters()
    grouped = []
    for text in texts:
        if not text:
            grouped.append([])
            continue
        a = byte.encode(" " + text, add_special_tokens=False).ids
        b = piece.encode(text)
        a_bytes = [bytes(letters[c] for c in byte.id_to_token(i)) for i in a]
        name = piece.id_to_piece
        b_bytes = [bytes([int(name(i)[3:5], 16)]) if piece.is_byte(i) else name(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            grouped.append([])
            continue
        ends = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        out, i, j = [], 0, 0
        for end in common:
            x, y = i, j
            while i < len(a) and ends[0][i] <= end:
                i += 1
            while j < len(b) and ends[1][j] <= end:
                j += 1
            out.append((a[x:i], b[y:j]))
        grouped.append(out)
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in grouped]
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for g, own in zip(grouped, links):
        spelled = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        rows.append((
            sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if g else "",
        ))
    return rows, count, most


def odd_texts():
    draw = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "ä", "übung", "日本", "😀", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "12345", "...", "a" * 40, "\x00", " ", " ", "é"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(150)]
    return [None, "", " ", "   ", "\n", "x", "▁", "a▁b", " lead", "trail ", "same text", "same text", "x" * 5000, *texts]


def scored(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id int, text string, run string, part int").repartition(5)
    got = alignment.score_links(docs, "doc_id", "text", A, B).collect()
    assert len(got) == len(texts)
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got}


def test_equals_brute_force(spark):
    texts = odd_texts()
    expected, _, _ = brute(texts)
    got = scored(spark, texts)
    for i, row in enumerate(expected):
        assert got[i] == row, (i, texts[i])


def test_small_runs_blocks_and_chunks(spark, monkeypatch):
    """Many spilled runs, merged block by block; long stretches in chunks."""
    texts = odd_texts()
    a, b = alignment.sides(A, B)
    rows = [("" if not t else " " + t).encode() for t in texts]
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 64)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 3)
    monkeypatch.setattr(alignment, "SPILL_RECORDS", 500)
    import numpy as np

    bits, radix = 16, 2
    by_part = defaultdict(list)
    for n in range(0, len(rows), 9):
        group = rows[n : n + 9]
        run = alignment.Run(bits, radix)
        data = np.frombuffer(b"".join(group), np.uint8)
        run.add(alignment.Aligned(a, b, data, np.cumsum([0, *map(len, group)])), len(data))
        for part, heads, _ in run.pieces():
            by_part[part].append(alignment.Cursor(n, heads))
    got = {}
    for cursors in by_part.values():
        for keys, _, total, best in alignment.merged(cursors, bits):
            for k, t, h in zip(alignment.straight(keys, bits, radix).tolist(), total.tolist(), best.tolist()):
                assert got.setdefault((k >> bits, k & (1 << bits) - 1), (t, h)) == (t, h)
    _, count, most = brute(texts)
    assert got == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_pair_counts_and_groups(spark):
    texts = ["the day", "the day", "a night", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, text string")
    _, count, most = brute(texts)
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.pair_counts(docs, "name", "text", A, B).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in count.items()}
    groups = {r.name: r.groups for r in alignment.aligned_groups(docs, "name", "text", A, B).collect()}
    assert groups["0"] == groups["1"] and groups["3"] == "" and groups["2"].count("|") == 2


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.score_links(empty, "doc_id", "text", A, B).collect() == []
    rows = alignment.score_links(spark.createDataFrame([(None, "one two"), (None, "one two")], "doc_id bigint, text string"), "doc_id", "text", A, B).collect()
    assert len(rows) == 2 and all(r.doc_id is None and r.count_sum == 2 * r.n_links for r in rows)


@pytest.mark.parametrize("values", [[], [0, 0], [1, 255, 256, 1 << 40]])
def test_pack_round_trip(values):
    import numpy as np

    assert alignment.unpack(alignment.pack(np.array(values, np.int64))).tolist() == values
