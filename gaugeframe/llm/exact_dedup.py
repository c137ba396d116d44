"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.llm.common import SPACE, body, flat, numbered, slices, small_batches, store

CHUNK = 1 << 16
# (modulus, base): primes below 2^31, so that a product of two residues fits 62 bits.
FIELDS = ((2147483647, 1103515245), (2147483629, 69069069))


def _powers(field: tuple[int, int], n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo the prime, by doubling."""
    modulus, base = field
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), modulus))
        out = np.concatenate([out, out * step % np.uint64(modulus)])
    return out[:n]


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    """Polynomial hash of every non-empty chunk of the flat bytes; all chunks at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    shift = np.repeat(np.cumsum(size), size) - 1 - np.arange(int(size.sum()))
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(field, int(size.max()))[shift]
    return np.add.reduceat(terms, np.cumsum(size) - size) % np.uint64(field[0])


def combine(left: tuple[int, int], right: tuple[int, int], field: tuple[int, int]) -> tuple[int, int]:
    """(length, hash) of two neighbouring pieces together: the left hash is shifted by the right length."""
    modulus, base = field
    return left[0] + right[0], (left[1] * pow(base, right[0], modulus) + right[1]) % modulus


def chunk_bounds(offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the chunks that cut every text from its own start; none for an empty text."""
    size = np.diff(offsets)
    count = -(-size // chunk)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[row] + number * chunk
    return row, starts, np.minimum(starts + chunk, offsets[row + 1])


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int, fields=FIELDS) -> list[np.ndarray]:
    """One fingerprint per field and text, combined from the chunk hashes."""
    row, starts, ends = chunk_bounds(offsets, chunk)
    out = []
    for field in fields:
        hashes = chunk_hashes(data, starts, ends, field)
        whole = np.zeros(len(offsets) - 1, np.int64)
        first = np.searchsorted(row, np.arange(len(offsets)))
        single = np.diff(first) == 1
        whole[single] = hashes[first[:-1][single]]
        for i in np.flatnonzero(np.diff(first) > 1):
            parts = [(int(ends[j] - starts[j]), int(hashes[j])) for j in range(first[i], first[i + 1])]
            whole[i] = reduce(lambda a, b: combine(a, b, field), parts)[1]
        out.append(whole)
    return out


def without_white(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flat texts without white space, and their offsets."""
    solid = ~SPACE[data]
    before = np.concatenate([[0], np.cumsum(solid)])
    return data[solid], before[offsets]


def _describe(chunk: int, fields):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            solid, bounds = without_white(data, offsets)
            raw = solid.tobytes()
            prints = fingerprints(solid, bounds, chunk, fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("id"),
                    pa.array(np.diff(points)),
                    pa.array(np.diff(bounds)),
                    *(pa.array(x) for x in prints),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]),
                ],
                names=["rid", "id", "chars", "size", *(f"f{i}" for i in range(len(prints))), "sha"],
            )

    return describe


def _chunks(chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            solid, bounds = without_white(*flat(batch.column("text")))
            row, starts, ends = chunk_bounds(bounds, chunk)
            raw = solid.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").take(pa.array(row)),
                    pa.array(starts - bounds[row], pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["rid", "at", "piece"],
            )

    return cut


def _unequal(docs: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """The ``rid`` of rows that differ from the row ``with_rid`` in some chunk.

    Only texts that take part are read on; they travel as chunks, so two long
    documents are never held whole, and a hot group's rows meet one chunk of the
    row they are held against in a join that can be split.
    """
    taking = pairs.select("rid").union(pairs.select(F.col("with_rid").alias("rid"))).distinct()
    texts = docs.join(taking, "rid").select("rid", F.col("text").cast("binary").alias("text"))
    pieces = texts.mapInArrow(_chunks(chunk), "rid bigint, at bigint, piece binary")
    own = pairs.join(pieces, "rid")
    other = pieces.select(F.col("rid").alias("with_rid"), "at", F.col("piece").alias("other"))
    both = own.join(other, ["with_rid", "at"], "left")
    return both.where(~F.col("piece").eqNullSafe(F.col("other"))).select("rid").distinct()


def exact_classes(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, fields=FIELDS) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after white space ``[\\x20\\x09-\\x0D]`` is deleted;
    null counts as empty, and empty texts are equal. Of equal rows the one with the
    most code points in the original text stays, then the smallest id (of any type that has an order, null last), then the first
    read; of repeated rows exactly one stays. ``kept`` tells that row; other columns
    are not read. An empty table gives none. ``docs`` is read once.

    Rows with the same length and fingerprints are compared chunk by chunk with the
    row that stays; those that differ form the next round, until none does.
    """
    stored, rid = numbered(docs.select(id_col, text_col))
    return _classes(stored, rid, id_col, text_col, chunk, fields).withColumnRenamed("id", id_col).drop("rid")


def _classes(docs: DataFrame, rid: str, id_col: str, text_col: str, chunk: int = CHUNK, fields=FIELDS) -> DataFrame:
    """:func:`exact_classes` of numbered rows, with the number as ``rid`` and the id as ``id``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), body(text_col).alias("text"))
    names = [f"f{i}" for i in range(len(fields))]
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("chars", "size", *names)]
        + [T.StructField("sha", T.StringType())]
    )
    described = rows.select("rid", "id", F.col("text").cast("binary").alias("text")).mapInArrow(_describe(chunk, fields), schema)
    rest = store(described, "fingerprints")
    key = ["size", *names]
    # The least rank stays; a null id comes after every other.
    rank = F.struct(-F.col("chars"), F.col("id").isNull(), "id", "rid")
    done = None
    while True:
        best = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("rid", "id"), rank).alias("best"))
        shared = store(best.where("n > 1"), "shared")  # stored, so that the join can split a hot group
        alone = F.col("n").isNull()
        labelled = rest.join(shared, key, "left").select(
            "rid", "id", "sha", "chars", *key, F.coalesce("n", F.lit(1).cast("bigint")).alias("n"),
            F.when(alone, F.col("rid")).otherwise(F.col("best.rid")).alias("with_rid"),
            F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        )
        pairs = store(labelled.where("n > 1 AND rid != with_rid").select("rid", "with_rid"), "pairs")
        differ = store(_unequal(rows, pairs, chunk), "unequal")
        if done is None and not differ.take(1):
            sized = labelled
            break
        equal = labelled.join(differ, "rid", "left_anti")
        done = equal if done is None else done.union(equal)
        if not differ.take(1):
            sizes = done.groupBy("with_rid").agg(F.count(F.lit(1)).alias("n"))
            sized = done.drop("n").join(sizes, "with_rid")
            break
        rest = store(rest.join(differ, "rid"), "fingerprints")
    return sized.select(
        "id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("with_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "rid",
    )


def drop_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`exact_classes`."""
    stored, rid = numbered(docs)
    classes = _classes(stored, rid, id_col, text_col).where("kept").select(F.col("rid").alias(rid))
    return stored.join(classes, rid, "left_semi").drop(rid)
