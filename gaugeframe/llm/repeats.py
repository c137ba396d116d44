"""Removal of byte strings that occur elsewhere, by a run-length index over candidate passages.

1. Equal texts are one text that occurs several times.
2. Every 200-byte window is dealt to the anchor it holds: the k-byte string with
   the lowest hash (the leftmost of equal ones). Equal windows have equal anchors
   at equal places, so a window can recur only among windows of the same anchor,
   and anchors met once are done.
3. The windows of an occurrence of an anchor lie in one short passage. Equal
   passages are sent once, with the number of their occurrences.
4. The passages of an anchor meet in one task, which builds the run-compressed
   Burrows-Wheeler transform of many anchors' passages. The longest match of a
   suffix with a neighbour in suffix order is computed at the ends of the runs
   only; between two sampled places it goes down by one per byte. Streaming these
   statistics along the passages marks every window that occurs twice.
5. An anchor with very many different passages is not sent to one task: its
   windows are counted by a 128-bit digest instead, spread over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import BASE, body, flat, mix, powers, release, shuffle_partitions, slices, small_batches, store
from gaugeframe.session import check_warehouse

INDEXED_BYTES = 1 << 17  # the sorts stay in the processor's cache
MOST_PASSAGES = 4096
BLOCK = 1 << 20
OTHER_BASE = np.uint64(0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of any substring of a byte block."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE):
        self.back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] ^ (end - start).astype(np.uint64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from the minima of blocks seen from both ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor key, passage hash, first window, number of windows and anchor place of each run of windows with one anchor.

    ``data`` is one block of a text; windows are numbered by their start.
    """
    rolling = Rolling(data)
    at = np.arange(len(data) - k + 1)
    own = rolling.of(at, at + k)
    low = np.uint64((1 << 21) - 1)
    least = sliding_minimum(own & ~low | at.astype(np.uint64), window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    place = (least[first] & low).astype(np.int64)
    passage = rolling.of(first, first + count + window - 1)
    return own[place], mix(passage ^ (place - first).astype(np.uint64)), first, count, place


def blocks_of(size: int, window: int) -> Iterator[tuple[int, int]]:
    """Parts of a text that hold each window once."""
    for at in range(0, max(size - window + 1, 0), BLOCK):
        yield at, min(at + BLOCK + window - 1, size)


def _anchor_rows(window: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            rows, out = [], []
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                for a, b in blocks_of(len(text), window):
                    key, passage, first, count, _ = anchors(text[a:b], window, k)
                    out.append((key.view(np.int64), passage.view(np.int64), first + a, count))
                    rows.append(np.full(len(key), row))
            if not out:
                continue
            owner = pa.array(np.concatenate(rows))
            key, passage, first, count = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(passage), batch.column("h1").take(owner), batch.column("h2").take(owner),
                 pa.array(first << 12 | count), batch.column("weight").take(owner)],
                names=["anchor", "passage", "h1", "h2", "span", "weight"],
            )

    return find


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes up to their separator, then by place, by doubling the sorted length of those that are still equal.

    ``left`` counts the symbols before the separator; symbols take 9 bits.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        key[: n - i] |= np.where(left[: n - i] >= i, symbols[i:], 0)
    order = np.argsort(key)
    ordered = key[order]
    rank, tied = np.empty(n, np.int64), np.arange(n)
    reach = 7
    while True:
        # A rank is the place of the first suffix of its group; only groups that are still equal and go on are sorted again.
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        heads = np.flatnonzero(fresh)
        several = np.repeat(np.diff(np.append(heads, len(tied))) > 1, np.diff(np.append(heads, len(tied))))
        rank[order[tied]] = tied[heads][np.cumsum(fresh) - 1]
        tied = tied[several & (left[order[tied]] >= reach)]
        if not len(tied):
            break
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + reach, n - 1)] + 1
        by = np.argsort(key)
        order[tied], ordered = at[by], key[by]
        reach *= 2
    # Equal up to their separators: by place.
    ranks = rank[order]
    same = ranks[1:] == ranks[:-1]
    equal = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    order[equal] = order[equal][np.lexsort((order[equal], ranks[equal]))]
    return order


def common_prefix(words: np.ndarray, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``; separators (0) never match."""
    size = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    last = len(symbols) - 1
    while len(live) and size.max() <= most:
        x, y = np.minimum(a[live] + size[live], last), np.minimum(b[live] + size[live], last)
        live = live[(words[x] == words[y]) & (words[x] >= 0)]
        size[live] += 7
    for _ in range(7):
        x, y = np.minimum(a + size, last), np.minimum(b + size, last)
        size += (symbols[x] == symbols[y]) & (symbols[x] > 0) & (a + size <= last) & (b + size <= last)
    return size


def repeated_windows(passages: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each passage the starts whose window also starts elsewhere in these passages.

    Passages end in separators that are all different, the earlier one lower.
    """
    size = np.array([len(p) for p in passages])
    symbols = np.zeros(int(size.sum()) + len(size), np.int64)
    ends = np.cumsum(size + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.concatenate(passages).astype(np.int64) + 1
    left = np.repeat(ends, size + 1) - np.arange(len(symbols))
    suffixes = suffix_order(symbols, left)
    # The transform, in runs: a run is a stretch of suffix order with one preceding byte; separators never form one.
    before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
    new_run = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
    heads = np.flatnonzero(new_run)
    words = np.zeros(len(symbols), np.int64)
    for i in range(7):
        words <<= 9
        words[: len(symbols) - i] |= symbols[i:]
    words[left < 7] = -1  # a separator is near: compared symbol by symbol
    # At a run's head the match with the suffix above is sampled, at its tail the match with the one below.
    inner = heads[heads > 0]
    above, below = suffixes[inner - 1], suffixes[inner]
    match = common_prefix(words, symbols, above, below, int(size.max()))
    longest = np.zeros(len(symbols), np.int64)
    place = np.arange(len(symbols))
    for sampled, lone in ((below, suffixes[0]), (above, suffixes[-1])):
        reach = np.full(len(symbols), -1)
        reach[lone] = lone
        reach[sampled] = sampled + match
        known = np.maximum.accumulate(np.where(reach >= 0, place, 0))
        longest = np.maximum(longest, reach[known] - place)  # one less per byte since the last sample
    hits = np.flatnonzero(longest >= window)
    cut = np.searchsorted(hits, np.concatenate([[0], ends + 1]))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [hits[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts)]


def _runs(starts: np.ndarray) -> list[int]:
    """first and last of each run of consecutive numbers, flat."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)
    return np.column_stack([starts[first], starts[last]]).ravel().tolist()


def _index_rows(window: int):
    """Marks for passages that come sorted by anchor; groups are indexed together up to ``INDEXED_BYTES``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, bool]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("anchor", "passage", "piece", "often")]
            for anchor, passage, piece, often in zip(*columns):
                if size > INDEXED_BYTES and anchor != held[-1][0]:
                    yield from answer(held)
                    held, size = [], 0
                held.append((anchor, passage, np.frombuffer(piece, np.uint8), often > 1))
                size += len(piece)
        yield from answer(held)

    def answer(held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        found = repeated_windows([piece for _, _, piece, _ in held], window)
        # All windows of a passage that occurs several times do so too; in the index it stands once, for the others.
        marks = [[0, len(piece) - window] if often else _runs(found[i]) for i, (_, _, piece, often) in enumerate(held)]
        kept = [i for i, m in enumerate(marks) if m]
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[i][j] for i in kept], pa.int64()) for j in (0, 1)] + [pa.array([marks[i] for i in kept], pa.list_(pa.int32()))],
            names=["anchor", "passage", "marks"],
        )

    return index


def _passage_rows(window: int):
    """The bytes of the wanted passages of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    first, count = w["span"] >> 12, w["span"] & 4095
                    out.append((w["anchor"], w["passage"], w["often"], w["hot"], text[first : first + count + window - 1]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "passage", "often", "hot", "piece"]
            )

    return cut


def _window_rows(window: int):
    """A row per window of a passage, with a 128-bit digest."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", 1 << 18):
            data, offsets = flat(batch.column("piece"))
            count = np.diff(offsets) - window + 1
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + place
            digests = [Rolling(data, base).of(start, start + window).view(np.int64) for base in (BASE, OTHER_BASE)]
            take = lambda n: batch.column(n).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [take("anchor"), take("passage"), take("often"), pa.array(place.astype(np.int32)), *map(pa.array, digests)],
                names=["anchor", "passage", "often", "place", "d1", "d2"],
            )

    return spell


def _spans_of(size: int, firsts: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal covered runs from (first start, last start) pairs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(firsts):
        end = min(b + window, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _result_rows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, copies, hits in zip(*(batch.column(n).to_pylist() for n in ("text", "copies", "hits"))):
                if copies > 1:
                    spans = [(0, len(text))] if len(text) >= window else []
                else:
                    firsts = [((h["span"] >> 12) + a, (h["span"] >> 12) + b) for h in hits or () for a, b in zip(h["marks"][::2], h["marks"][1::2])]
                    spans = _spans_of(len(text), firsts, window)
                gone = sum(b - a for a, b in spans)
                digest = hashlib.sha256()
                at = 0
                for a, b in [*spans, (len(text), len(text))]:
                    digest.update(text[at:a])
                    at = b
                out.append((len(text), gone, len(spans), digest.hexdigest(), [x for s in spans for x in s]))
            sizes, gone, count, digests, spans = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
                names=["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return cut


TEXT_KEY = ("h1", "h2")


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int = 200, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``.

    A byte is removed if a ``window``-byte string that covers it also starts anywhere
    else in any text, itself included. ``spans`` are the maximal removed runs as
    start, end, start, end … in bytes. Null counts as empty and is never removed from;
    of repeated rows and equal texts of ``window`` bytes or more every copy goes whole.
    Null ids come out as they are, other columns are not read, an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    k = max(window // 5, 1)
    text = body(text_col)
    key = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]

    # Each text once, in a table bucketed by its digest: later joins bring rows to the texts and move no text.
    check_warehouse(spark)
    table = f"texts_{uuid.uuid4().hex[:12]}"
    one = docs.select(*key, text.cast("binary").alias("text")).groupBy(*TEXT_KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    one.write.bucketBy(parts, *TEXT_KEY).option("compression", "zstd").saveAsTable(table)
    release(spark)
    texts = spark.table(table)
    weighed = texts.select("h1", "h2", "text", F.least("copies", F.lit(2)).alias("weight"))

    occurrences = weighed.where(F.octet_length("text") >= window).mapInArrow(
        _anchor_rows(window, k), "anchor bigint, passage bigint, h1 bigint, h2 bigint, span bigint, weight bigint"
    )
    often = store(occurrences.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"), "recurring")
    met = store(occurrences.join(often, "anchor"), "anchors")  # a join that can split an anchor met very often

    distinct = met.groupBy("anchor", "passage").agg(F.sum("weight").alias("often"), F.min(F.struct("h1", "h2", "span")).alias("one"))
    distinct = store(distinct, "passages")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_passages).select("anchor", F.lit(True).alias("hot"))
    wanted = distinct.join(crowded, "anchor", "left").select(
        "one.h1", "one.h2", F.struct("one.span", "anchor", "passage", "often", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w")
    )
    asked = wanted.groupBy(*TEXT_KEY).agg(F.collect_list("w").alias("wanted"))  # bounded by the length of the text
    pieces = store(
        texts.join(asked, list(TEXT_KEY)).select("text", "wanted").mapInArrow(
            _passage_rows(window), "anchor bigint, passage bigint, often bigint, hot boolean, piece binary"
        ),
        "pieces",
    )
    marks = (
        pieces.where("NOT hot").repartition(parts, "anchor").sortWithinPartitions("anchor", "passage")
        .mapInArrow(_index_rows(window), "anchor bigint, passage bigint, marks array<int>")
    )
    windows = pieces.where("hot").mapInArrow(
        _window_rows(window), "anchor bigint, passage bigint, often bigint, place int, d1 bigint, d2 bigint"
    )
    again = windows.groupBy("anchor", "d1", "d2").agg(F.sum("often").alias("n")).where("n > 1").drop("n")
    counted = windows.join(again, ["anchor", "d1", "d2"]).groupBy("anchor", "passage").agg(F.collect_set("place").alias("places"))
    flat_marks = F.flatten(F.transform("places", lambda p: F.array(p, p)))
    marks = store(marks.union(counted.select("anchor", "passage", flat_marks.alias("marks"))), "marks")

    hits = met.where("weight = 1").join(marks, ["anchor", "passage"])
    hits = hits.groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("span", "marks")).alias("hits"))
    answers = texts.join(hits, list(TEXT_KEY), "left").mapInArrow(
        _result_rows(window),
        "h1 bigint, h2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>",
    )
    answers = store(answers, "answers")
    rows = docs.select(F.col(id_col).alias("__id"), *key)
    return rows.join(answers, list(TEXT_KEY)).select(
        F.col("__id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"
    )
