"""Pieces the text operators share: scratch tables, Arrow batches as flat byte arrays, word hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.session import scratch_dir

WHITE = "\t\n\x0b\x0c\r "  # fixed: the characters of [\x20\x09-\x0D]
SLICE_BYTES = 2 << 20


def body(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that a later step never repeats the work.

    The files outlive lost executors. The shuffle files of the finished step are
    released, since the context frees them only when the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=compression)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, stored, and the name of that column, which ``docs`` does not have.

    The numbers follow the file splits, and those the cores of the moment: made anew
    in a later job, they could name other rows.
    """
    name = unused(docs, "rid")
    return store(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd"), name


def release(spark: SparkSession) -> None:
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, since one row can be a whole book."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a binary or string column without nulls, and the n + 1 row offsets."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


HELD: dict = {}  # what a worker keeps from task to task, by name


def let_go(but: str | None = None) -> None:
    """Drop what the worker keeps for other work, and give that memory back to the system.

    Workers are used again by later steps, which would have it on top of their own.
    """
    other = [name for name in HELD if name != but]
    for name in other:
        del HELD[name]
    if other:
        gc.collect()
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, uses: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at most ``most`` bytes of text; a longer text is a run of its own.

    Of what the worker holds, only what the step ``uses`` stays.
    """
    let_go(uses)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of every row."""
    return np.diff(flat(column)[1])


KNOWN_BYTES = 96 << 20
LONGEST_UNIT = 1 << 10
UNIT_COST = 160  # bytes of one entry besides its unit and numbers


class Known:
    """Number sequences of units met before, in one array; units stay while they take up to ``most`` bytes.

    Units over ``LONGEST_UNIT`` are never kept, so what a worker holds is bounded by bytes for any text.
    """

    def __init__(self, most: int = KNOWN_BYTES):
        self.most, self.held, self.full = most, 0, False
        self.place: dict = {}
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def look_up(self, units: list, work_out) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each unit's sequence, and the array that holds them.

        ``work_out(list of new units)`` gives their sizes and their sequences in a row.
        """
        get = self.place.get
        place = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        sizes, pool = self.sizes, self.pool
        if len(new):
            fresh = [units[i] for i in new]
            more, row = work_out(fresh)
            place[new] = len(sizes) + np.arange(len(new))
            sizes, pool = np.concatenate([sizes, more]), np.concatenate([pool, row])
            self._keep(fresh, more, row)
        return (np.cumsum(sizes) - sizes)[place], sizes[place], pool

    def _keep(self, fresh: list, more: np.ndarray, row: np.ndarray) -> None:
        if self.full:
            return
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        room = np.cumsum(np.where(sizes <= LONGEST_UNIT, sizes + UNIT_COST + 4 * more, 0))
        fits = self.held + room <= self.most
        self.full = not fits.all()
        kept = np.flatnonzero(fits & (sizes <= LONGEST_UNIT))
        if not len(kept):
            return
        if len(kept) < len(fresh):
            row, _ = gather((np.cumsum(more) - more)[kept], more[kept], row)
            more, fresh = more[kept], [fresh[i] for i in kept.tolist()]
        self.held += int(room[kept[-1]])
        self.place.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
        self.sizes, self.pool = np.concatenate([self.sizes, more]), np.concatenate([self.pool, row])


def gather(starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``pool`` one after the other, and the n + 1 offsets."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pool[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[list(WHITE.encode())] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of the flat texts; ``between`` marks the bytes that separate words."""
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    terms = (data[np.repeat(starts, size) + place].astype(np.uint64) + np.uint64(1)) * powers(BASE, int(size.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) ^ size.astype(np.uint64))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, mixed anew after each eight bytes, so that no pattern of letters makes words collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * BASE + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = size[live] - at
        chunk = np.zeros(len(live), np.uint64)
        for i in range(8):
            byte = padded[starts[live] + at + i].astype(np.uint64) << np.uint64(8 * i)
            chunk |= np.where(left > i, byte, np.uint64(0))
        out[live] = mix((out[live] ^ chunk) * BASE + np.uint64(at + 1))
        at += 8
        live = live[left > 8]
    return out


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of every word, equal for equal words only."""
    size = ends - starts
    place = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data[place]))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int, of_words, join) -> tuple[np.ndarray, np.ndarray]:
    """Values of the distinct ``width``-word shingles of every text, sorted within a row, and the n + 1 row offsets.

    A-Z count as a-z. A text of fewer words has its whole sequence as one shingle; a text without words has none.
    ``of_words`` gives a value to every word, ``join`` one to a sequence of which one more word is known.
    """
    data = LOWER[data]
    starts, ends, row = word_bounds(data, offsets)
    words = of_words(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    size = np.where(count >= width, np.maximum(count - width + 1, 0), np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), size)
    start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    left = np.minimum(count, width)[owner]  # words of each shingle
    value = join(np.zeros(len(start), words.dtype), left.astype(words.dtype))
    for i in range(width):
        more = np.flatnonzero(left > i)
        value = join(value, words[start[more] + i], more)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[: len(value)]
    return value[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(count)))])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of every text (see ``shingle_rows``)."""

    def join(value: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            return mix(value * BASE + word)
        value[at] = mix(value[at] * BASE + word)
        return value

    return shingle_rows(data, offsets, width, word_digests, join)


def exact_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of every text, equal for equal shingles of these texts only."""

    def join(value: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        both = (value if at is None else value[at]) << 32 | word
        if at is None:
            return np.unique(both, return_inverse=True)[1]
        value[at] = len(value) + np.unique(both, return_inverse=True)[1]
        return np.unique(value, return_inverse=True)[1]

    return shingle_rows(data, offsets, width, word_numbers, join)
