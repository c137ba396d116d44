"""Shards of bounded size by extendible hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import body, store

STEP = 16
HASH_BITS = 60


def _bits(text: str) -> str:
    """SQL for the first 60 bits of the MD5 of a text, as zeros and ones."""
    return f"lpad(conv(substr(md5({text}), 1, {HASH_BITS // 4}), 16, 2), {HASH_BITS}, '0')"


def assign_shards(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Per row: id, ``n_bytes``, ``shard``, ``depth``, ``shard_bytes`` and ``shard_rows``.

    ``shard`` is a prefix of the hash bits of the id: a bucket that holds more than ``limit``
    bytes of text is split on its next bit, others stay as they are. Rows of one id
    have equal bits; if they alone exceed the limit, the bits of the text's hash go on, then those of
    the row's number, so that a shard never exceeds it unless it is one single row.
    Null ids hash as empty text, null texts have 0 bytes; repeated rows are rows of
    their own; other columns are not read; an empty table gives none. ``docs`` must be
    a stored table, as its rows are numbered more than once.

    The buckets are decided on sums by the next ``STEP`` bits, so the rows are read once for
    each ``STEP`` bits of depth and later rounds read only buckets that are still too large.
    """
    row_bits = F.lpad(F.bin("rid"), 64, "0")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), body(text_col).alias("text"))
    rows = rows.select(
        "id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.concat(F.expr(_bits("coalesce(cast(id AS STRING), '')")), F.expr(_bits("text")), row_bits).alias("bits"),
    )
    rows = store(rows, "hashed")
    done, left, depth = None, rows, 0
    while True:
        cell = F.substring("bits", depth + 1, STEP)
        head = F.substring("bits", 1, depth)
        cells = left.groupBy(head.alias("head"), cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        # Every prefix of a cell, from the head itself on; the head fits only in the first round.
        lengths = F.sequence(F.lit(0 if depth == 0 else 1), F.lit(STEP))
        grown = store(cells, "cells").withColumn("length", F.explode(lengths)).withColumn("tail", F.substring("cell", F.lit(1), F.col("length")))
        sums = grown.groupBy("head", "length", "tail").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        best = F.min(F.struct("length", "tail", "shard_bytes", "shard_rows")).alias("best")
        leaves = store(grown.join(fits, ["head", "length", "tail"]).groupBy("head", "cell").agg(best), "leaves")
        placed = left.withColumns({"head": head, "cell": cell}).join(leaves, ["head", "cell"], "left")
        here = placed.where("best IS NOT NULL").select(
            F.col("id").alias(id_col), "n_bytes", F.concat("head", "best.tail").alias("shard"),
            (F.col("best.length") + depth).alias("depth"), "best.shard_bytes", "best.shard_rows",
        )
        done = here if done is None else done.union(here)
        rest = placed.where("best IS NULL").select("id", "n_bytes", "bits")
        if not rest.take(1):
            return done
        left, depth = store(rest, "too-large"), depth + STEP


def directory(shards: DataFrame) -> DataFrame:
    """The directory: each shard with the range of entries that point to it, of 2^(greatest depth) entries.

    Entries are bit strings of the greatest depth; ``first`` and ``last`` end the range.
    """
    one = shards.groupBy("shard").agg(F.first("depth").alias("depth"), F.first("shard_bytes").alias("bytes"), F.first("shard_rows").alias("rows"))
    most = one.agg(F.max("depth")).scalar()
    return one.select(
        "shard", "depth", "bytes", "rows",
        F.rpad("shard", most, F.lit("0")).alias("first"), F.rpad("shard", most, F.lit("1")).alias("last"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, id_col: str, path: str) -> None:
    """Write whole rows as Parquet, a folder per shard; ids must name a row."""
    named = docs.join(shards.select(id_col, F.col("shard").alias("__shard")), id_col)
    named.repartition("__shard").write.partitionBy("__shard").parquet(path)
