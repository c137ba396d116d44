"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

The packing is planned on the histogram of piece lengths, which has at most
``capacity`` entries at any input size: a bitset subset-sum program finds the
fullest combination of available lengths, and a combination is used as often as
the counts allow. Spark then ranks the pieces of each length and looks every rank
up in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import HELD, Known, body, gather, slices, small_batches, store

TOKENIZED_BYTES = 2 << 20
RANKED_ROWS = 100_000


class WordEncoder:
    """Token ids of texts by a tokenizer whose pieces never cross ASCII white space.

    Texts are cut at white space and every distinct word is encoded once; the
    library does the encoding. Before that an ASCII word is put in lower case and a
    closing comma or full stop is cut off, as the tokenizer's own rules do, unless
    the word may hold a special token. Words met stay known up to a number of bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.parts = Known(), Known()

    @staticmethod
    def cut(word: str) -> tuple[str, ...]:
        if "<" in word or ">" in word:
            return (word,)
        if len(word) > 1 and word[-1] in ".," and word[-2].isascii() and word[-2].isalpha():
            return (word[:-1].lower() if word.isascii() else word[:-1], word[-1])
        return (word.lower() if word.isascii() else word,)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([len(x) for x in ids], np.int64), np.fromiter(chain.from_iterable(ids), np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.cut(w) for w in words]
        every = list(chain.from_iterable(cut))
        parts = list(dict.fromkeys(every))
        starts, sizes, pool = self.parts.look_up(parts, self.encode_parts)
        number = dict(zip(parts, range(len(parts))))
        own = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        row, ends = gather(starts[own], sizes[own], pool)
        last = np.cumsum([len(c) for c in cut])
        return np.diff(np.concatenate([[0], ends[last]])), row

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the n + 1 offsets."""
        split = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        starts, sizes, pool = self.words.look_up(coded.dictionary.to_pylist(), self.encode_words)
        word = coded.indices.to_numpy()
        row, ends = gather(starts[word], sizes[word], pool)
        offsets = np.frombuffer(split.buffers()[1], np.int64 if pa.types.is_large_list(split.type) else np.int32, len(split) + 1)
        return row, ends[offsets - offsets[0]]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file, until the worker goes on to other work."""
    if path not in HELD:
        HELD[path] = WordEncoder(path)
    return HELD[path]


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document: ids, then ``end_id``, cut every ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in slices(batches, "text", TOKENIZED_BYTES, uses=tokenizer_path):
            ids, offsets = coder.texts(batch.column("text"))
            owner, piece, start, length, crc = [], [], [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id)).astype("<u4")
                raw = own.tobytes()
                for number, at in enumerate(range(0, len(own), capacity)):
                    owner.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(min(capacity, len(own) - at))
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    )
    return docs.select(F.col(id_col).alias("id"), body(text_col).alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], target: int) -> list[tuple[int, int]]:
    """Lengths and how often each is used, for the greatest sum up to ``target``.

    Bit ``t`` of the bitset says that some of the lengths seen so far add up to ``t``;
    a length that is there c times enters as 1, 2, 4, … of it.
    """
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((n for n in counts if n <= target and counts[n]), reverse=True):
        left, block = min(counts[length], target // length), 1
        while left:
            block = min(block, left)
            steps.append((reach, length, block))
            reach |= reach << (length * block) & mask
            left -= block
            block *= 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, block in reversed(steps):
        if not before >> total & 1:
            total -= length * block
            used[length] = used.get(length, 0) + block
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, lengths with multiplicity) per kind of bin; the longest piece left opens the next kind."""
    counts = {n: c for n, c in histogram.items() if c}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // m for n, m in used.items())
        for n, m in used.items():
            counts[n] -= times * m
            if not counts[n]:
                del counts[n]
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length the ranks that go to each kind of bin, in order of (length, first rank)."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for times, parts in plan:
        offset = 0
        for length, often in parts:
            first = used.get(length, 0)
            used[length] = first + times * often
            rows.append((length, first, often, bins, offset))
            offset += length * often
        bins += times
    rows.sort()
    names = ("length", "first", "often", "bin", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed as
    they are; other columns are not read. An empty table gives none.

    What reaches the driver is the histogram (at most ``capacity`` rows); what goes
    to the tasks is the plan, whose size depends on the number of lengths and the
    logarithm of their counts. Ranks within a length are counted in buckets of some
    ``RANKED_ROWS`` rows, so a length that a third of all pieces have is not one task.
    """
    small_batches(docs.sparkSession)
    pieces = store(tokenized_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))
    buckets = sum(histogram.values()) // RANKED_ROWS + 1
    order = F.struct(F.col(id_col), "piece", "ids_crc32")
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(order))
    ranked = dealt.withColumn("__in", inside).join(starts, ["length", "__bucket"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("__first") + F.col("__in") - 1).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "__rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                low, high = np.searchsorted(slots["length"], [n, n + 1])
                at[own] = low + np.searchsorted(slots["first"][low:high], rank[own], side="right") - 1
            inside = rank - slots["first"][at]
            sequence = slots["bin"][at] + inside // slots["often"][at]
            offset = slots["offset"][at] + inside % slots["often"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in (id_col, "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = T.StructType(pieces.schema.fields + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")])
    return ranked.mapInArrow(place, schema)
