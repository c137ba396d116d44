"""Benchmark passages in training text, found by suffix arrays over shards of the texts.

The benchmark is the query set. Its words are numbered, and the texts are read as rows of these
numbers; words that no item has end a match. A task sorts the suffixes of some ``SLICE_BYTES``
of text by their numbers and looks every benchmark suffix up in them by binary search: the neighbours
of its place give its longest verbatim match, the places that agree on a whole window give all
occurrences. A text lies in one shard, so no match crosses texts and none is lost between shards.

The benchmark is taken in blocks of bounded size, one after the other, so a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import BASE, LOWER, body, flat, gather, mix, powers, slices, small_batches, store, word_bounds

WINDOW = 10
SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
BLOCK_BYTES = 32 << 20
# Fixed: bytes that are in no word, [\x00-\x2F\x3A-\x60\x7B-\x7F]; upper case is lowered before.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, and start, end and row of every word."""
    data = LOWER[data]
    return (data, *word_bounds(data, offsets, BETWEEN))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal hashes are compared by ``same_bytes`` before they count."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])
    back = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] ^ (ends - starts).astype(np.uint64))


def same_bytes(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces of ``x`` and ``y`` of these sizes (one byte at least) are equal."""
    if not len(size):
        return np.zeros(0, bool)
    a, ends = gather(x_start, size, x)
    b, _ = gather(y_start, size, y)
    return np.logical_and.reduceat(a == b, ends[:-1])


class Words:
    """The distinct words of the benchmark, numbered from 1 on; 0 is any other word."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(set(words))
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        hashes = hashes_of(self.data, self.start, self.start + self.size)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of every word of a text, by its hash, with the bytes compared; words of one hash are tried in turn."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.words) or not len(starts):
            return out
        own = hashes_of(data, starts, ends)
        place = np.searchsorted(self.hashes, own)
        live = np.arange(len(starts))
        while len(live):
            live = live[place[live] < len(self.hashes)]
            live = live[self.hashes[place[live]] == own[live]]
            word = self.order[place[live]]
            like = np.flatnonzero(self.size[word] == ends[live] - starts[live])
            good = like[same_bytes(data, starts[live[like]], self.data, self.start[word[like]], self.size[word[like]])]
            out[live[good]] = word[good] + 1
            live = np.delete(live, good)
            place[live] += 1
        return out


class Benchmark:
    """One block of items: their words as numbers, in a row with a 0 after each item, and the distinct windows."""

    def __init__(self, names: list[str | None], texts: list[bytes], window: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        data, starts, ends, rows = words_of(data, offsets)
        raw = data.tobytes()
        self.vocabulary = Words([raw[a:b] for a, b in zip(starts, ends)])
        number = self.vocabulary.numbers(data, starts, ends)
        count = np.bincount(rows, minlength=len(texts))
        self.names, self.count = names, count
        place = np.arange(len(number)) + rows
        self.row = np.zeros(len(number) + len(texts), np.int64)
        self.row[place] = number
        self.first = np.cumsum(count + 1) - count - 1
        self.starts, self.item = place, rows  # every suffix of every item
        left = self.first[rows] + count[rows] - place
        # The windows, each once, with the items that hold it.
        whole = (left >= window) | ((place == self.first[rows]) & (count[rows] < window))
        held: dict[tuple, list[int]] = {}
        for at, size, item in zip(place[whole].tolist(), np.minimum(left, window)[whole].tolist(), rows[whole].tolist()):
            held.setdefault(tuple(self.row[at : at + size].tolist()), []).append(item)
        self.window_start = np.zeros(len(held), np.int64)
        self.window_size = np.array([len(w) for w in held], np.int64)
        self.window_items = [sorted(set(items)) for items in held.values()]
        self.window_row = np.array([n for w in held for n in w], np.int64)
        self.window_start = np.cumsum(self.window_size) - self.window_size
        self.left = left


class Shard:
    """Texts as rows of word numbers with a 0 after each, and the order of the suffixes that start with a benchmark word."""

    def __init__(self, benchmark: Benchmark, data: np.ndarray, offsets: np.ndarray):
        data, starts, ends, rows = words_of(data, offsets)
        texts = len(offsets) - 1
        self.n_words = np.bincount(rows, minlength=texts)
        self.place = np.arange(len(starts)) + rows  # of each word, texts end in a 0
        self.row = np.zeros(len(starts) + texts, np.int64)
        self.row[self.place] = benchmark.vocabulary.numbers(data, starts, ends)
        self.first = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.suffixes = suffix_order(self.row, len(benchmark.vocabulary.words), int(benchmark.count.max(initial=0)))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def bounds(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of every query (``size`` numbers from ``start`` of ``row``): the suffixes below it, or with those that begin with it."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.suffixes))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            sign = self._compare(self.suffixes[middle], row, start[open_], size[open_])
            up = sign <= 0 if after else sign < 0
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]

    def _compare(self, suffix: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix against the query, up to the query's length."""
        sign = np.zeros(len(suffix), np.int64)
        live, step = np.arange(len(suffix)), 0
        while len(live):
            live = live[size[live] > step]
            x, y = self.row[suffix[live] + step], row[start[live] + step]
            sign[live] = np.sign(x - y)
            live, step = live[x == y], step + 1  # numbers of a query are above 0, so a text's end never agrees
        return sign

    def common(self, suffix: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many numbers the suffix and the query share from their starts."""
        shared = np.zeros(len(suffix), np.int64)
        live = np.arange(len(suffix))
        while len(live):
            live = live[size[live] > shared[live]]
            live = live[self.row[suffix[live] + shared[live]] == row[start[live] + shared[live]]]
            shared[live] += 1
        return shared


def suffix_order(row: np.ndarray, highest: int, depth: int) -> np.ndarray:
    """Places above 0 by the numbers from there up to the next 0, at least up to ``depth`` numbers.

    Some numbers are sorted at once, packed in one key; then only groups that are still equal are sorted
    by the rank of what follows, twice as far each time.
    """
    places = np.flatnonzero(row > 0)
    if not len(places):
        return places
    bits = max(int(highest).bit_length(), 1)
    reach = max(min(62 // bits, max(depth, 1)), 1)
    key = np.zeros(len(row) + reach, np.int64)
    ended = np.zeros(len(row), bool)
    for i in range(reach):
        nxt = np.zeros(len(row), np.int64)
        nxt[: len(row) - i] = row[i:]
        ended |= nxt == 0
        key[: len(row)] = key[: len(row)] << bits | np.where(ended, 0, nxt)
    order = places[np.argsort(key[places], kind="stable")]
    rank = np.zeros(len(row) + 1, np.int64)  # 0: a word that is not in the benchmark, or the end
    group = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
    rank[order] = np.repeat(group, np.diff(np.append(group, len(order)))) + 1
    while reach < depth:
        # Groups of several suffixes that go on: only their members change places.
        size = np.bincount(rank[order], minlength=len(order) + 2)
        after = np.minimum(order + reach, len(row))
        cut = ended_within(row, order, reach)
        tied = np.flatnonzero((size[rank[order]] > 1) & ~cut)
        if not len(tied):
            break
        several = rank[order[tied]]
        whole = np.flatnonzero(np.isin(rank[order], several))
        follow = np.where(cut[whole], 0, rank[after[whole]])
        by = np.lexsort((follow, rank[order[whole]]))
        old, nxt = rank[order[whole[by]]], follow[by]
        moved = order[whole][by]
        order[whole] = moved
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])])
        heads = whole[np.flatnonzero(fresh)]
        rank[moved] = heads[np.cumsum(fresh) - 1] + 1
        reach *= 2
    return order


def ended_within(row: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Whether a 0 comes within ``reach`` numbers from each place."""
    zeros = np.flatnonzero(row == 0)
    nxt = np.append(zeros, len(row))[np.searchsorted(zeros, places)]
    return nxt < places + reach


def _hits(shard: Shard, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word place in the shard and window of every occurrence."""
    query = benchmark.window_row, benchmark.window_start, benchmark.window_size
    low, high = shard.bounds(*query, after=False), shard.bounds(*query, after=True)
    window = np.repeat(np.arange(len(low)), high - low)
    at = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[window]
    place = shard.suffixes[at]
    return shard.text_of(place), place, window


def _find(block: Benchmark, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shard = Shard(block, *flat(batch.column("text")))
            text, place, window = _hits(shard, block)
            texts = batch.num_rows
            # Covered words, by adding up where windows start and end.
            edge = np.zeros(len(shard.row) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + block.window_size[window], -1)
            covered = np.cumsum(edge[:-1]) > 0
            change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            firsts, lasts = change[::2], change[1::2]
            owner = shard.text_of(firsts)
            cut = np.searchsorted(owner, np.arange(texts + 1))
            spans = pa.StructArray.from_arrays([pa.array(x - shard.first[owner]) for x in (firsts, lasts)], names=["first", "end"])
            pairs = np.unique(text * max(len(block.window_size), 1) + window)
            items: list[list[str]] = [[] for _ in range(texts)]
            seen: list[set] = [set() for _ in range(texts)]
            for t, w in zip((pairs // max(len(block.window_size), 1)).tolist(), (pairs % max(len(block.window_size), 1)).tolist()):
                seen[t].update(block.window_items[w])
            for t in np.unique(text):
                items[t] = sorted({block.names[i] for i in seen[t]} - {None})
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), pa.array(shard.n_words),
                 pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans), pa.array(items, pa.list_(pa.string()))],
                names=["rid", "id", "n_words", "spans", "items"],
            )

    return find


def _longest(block: Benchmark, least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shard = Shard(block, *flat(batch.column("text")))
            if not len(shard.suffixes):
                continue
            query = block.row, block.starts, block.left
            at = shard.bounds(*query, after=False)
            best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for near in (np.minimum(at, len(shard.suffixes) - 1), np.maximum(at - 1, 0)):
                shared = shard.common(shard.suffixes[near], *query)
                better = shared > best
                best[better], where[better] = shared[better], shard.suffixes[near[better]]
            found = np.flatnonzero(best >= least)
            text = shard.text_of(where[found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.names[i] for i in block.item[found]], pa.string()), pa.array(block.starts[found] - block.first[block.item[found]]),
                 pa.array(best[found]), batch.column("id").take(pa.array(text)), pa.array(where[found] - shard.first[text])],
                names=["item_id", "item_word", "n_words", "id", "word"],
            )

    return find


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_bytes``, dealt by hash; a block is fetched when its turn comes."""
    items = store(benchmark.select(F.col(item_col).cast("string").alias("name"), body(text_col).cast("binary").alias("text")).distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    for number in range(count):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == number).collect()
        block = Benchmark([r["name"] for r in rows], [bytes(r["text"]) for r in rows], window)
        if len(block.starts):
            yield block


def _own(docs: DataFrame, id_col: str, text_col: str, rid) -> DataFrame:
    return docs.select(rid.alias("rid"), F.col(id_col).alias("id"), body(text_col).cast("binary").alias("text"))


def benchmark_hits(
    docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str,
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``spans``, ``items``.

    Words are runs of a-z, 0-9 and bytes from 0x80 on, A-Z as a-z. A window is ``window`` words in a row
    of an item; an item of fewer words is one window, one without words none. ``spans`` are the maximal
    runs of words that lie in occurrences of windows, from ``first`` up to ``end``; ``items`` the ids of the items
    with occurring windows as texts, each once, sorted. Null texts have no words. Items with a null id mark words and are
    not listed; repeated items count once. Null ids and repeated rows of ``docs`` come out as they are, other
    columns are not read, an empty table gives none; an empty benchmark marks nothing.

    A benchmark of one block is looked up in one pass without a shuffle; with more blocks the rows are numbered and
    stored, and the few rows with hits are merged.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
         T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first = next(blocks, Benchmark([], [], window))
    second = next(blocks, None)
    if second is None:
        return _own(docs, id_col, text_col, F.lit(0).cast("bigint")).mapInArrow(_find(first, window), schema).select(F.col("id").alias(id_col), "n_words", "spans", "items")
    numbered = store(_own(docs, id_col, text_col, F.monotonically_increasing_id()), "numbered", "zstd")
    found = store(numbered.mapInArrow(_find(first, window), schema), "hits")
    rows, hits = found.select("rid", "id", "n_words"), found.where("size(items) > 0 OR size(spans) > 0").select("rid", "spans", "items")
    block = second
    while block is not None:
        more = numbered.mapInArrow(_find(block, window), schema).where("size(items) > 0 OR size(spans) > 0").select("rid", "spans", "items")
        hits = hits.union(store(more, "hits"))
        block = next(blocks, None)
    merged = hits.groupBy("rid").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(merged, "rid", "left")
    spans = F.coalesce(_united(F.col("spans")), F.array().cast("array<struct<first:bigint,end:bigint>>"))
    return joined.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _united(lists):
    """The maximal runs of several lists of spans."""
    start = F.array().cast("array<struct<first:bigint,end:bigint>>")
    last = lambda done: F.get(done, F.size(done) - 1)
    grow = lambda done, s: F.when(
        last(done)["end"] >= s["first"],
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["first"].alias("first"), F.greatest(last(done)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(F.flatten(lists)), start, grow)


def longest_matches(
    docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str,
    least: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every benchmark suffix with a verbatim match of ``least`` words or more: ``item_id``, ``item_word`` (where it starts),
    ``n_words`` (the longest match in all texts), and one place of it: ``id`` and ``word``; of equal ones the smallest."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()),
         T.StructField("id", kind), T.StructField("word", T.LongType())]
    )
    own = _own(docs, id_col, text_col, F.lit(0).cast("bigint"))
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col, WINDOW, block_bytes):
        found = found.union(own.mapInArrow(_longest(block, max(least, 1)), schema))
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "id", "word")).alias("best")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", (-F.col("best.less")).alias("n_words"), F.col("best.id").alias(id_col), "best.word")


def drop_contaminated(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, as they are, whose text holds no window of the benchmark."""
    name = "rid"
    while name in docs.columns:
        name += "_"
    stored = store(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd")
    hits = benchmark_hits(stored, name, text_col, benchmark, item_col, item_text_col, window).where("size(spans) > 0")
    return stored.join(hits.select(name), name, "left_anti").drop(name)
