"""Positions, running totals and codes that hold when one group has most of the rows.

A window over a whole group would send the group to one task. Here each group is
cut into buckets of its order column; the bucket counts (or sums), one for some
100,000 rows, give every bucket its offset, and the window runs inside a bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, null_safe_join

BUCKET_VALUES = 100_000
MOST_SPLITS = 4096
KEY_LETTERS = 64


def _below(splits: Column, value: Column) -> Column:
    """How many of the sorted split points are not above the value, by binary search."""
    bits = F.length(F.bin(F.size(splits)))
    halves = F.transform(F.sequence(F.lit(1), bits), lambda i: F.call_function("shiftleft", F.lit(1), bits - i))
    reach = lambda at, step: F.get(splits, at + step - 1) <= value
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at))
    return F.when(F.coalesce(F.size(splits), F.lit(0)) == 0, F.lit(0)).otherwise(below).cast("bigint")


def _with_bucket(df: DataFrame, order_by: str, values: int, most: int = MOST_SPLITS) -> DataFrame:
    """Add ``__bucket``, a non-decreasing function of the order column (of its first letters, if a text).

    Split points are the distinct values whose hash is a multiple of ``values``: an even sample that comes
    out the same on every run, so a bucket holds some ``values`` distinct values. At most ``most`` of them, those with
    the least hashes, are one list in every row. Where there are more, the others divide the parts between these,
    each part with its own short list, which is joined; no list and no window grows with the rows.
    """
    short = F.substring(col(order_by), 1, KEY_LETTERS) if df.schema[order_by].dataType.typeName() == "string" else col(order_by)
    hashed = F.xxhash64("v")
    sample = df.select(short.alias("v")).where(F.col("v").isNotNull() & (F.pmod(hashed, F.lit(values)) == 0)).distinct()
    coarse = sample.orderBy(hashed, "v").limit(most)
    first = coarse.select(F.sort_array(F.collect_list("v"))).scalar()
    marked = df.withColumn("__splits", first).withColumn("__short", short)
    marked = marked.withColumn("__part", _below(F.col("__splits"), F.col("__short"))).drop("__splits")
    # What the first list left out, by the part of it; none at all for tables of usual size.
    rest = sample.withColumn("__splits", first).where(F.size("__splits") >= most)
    rest = rest.select(_below(F.col("__splits"), F.col("v")).alias("__part"), "v").groupBy("__part").agg(F.sort_array(F.collect_list("v")).alias("__fine"))
    placed = marked.join(rest, "__part", "left")
    bucket = F.col("__part") * F.lit(1 << 32) + _below(F.col("__fine"), F.col("__short"))
    return placed.withColumn("__bucket", bucket).drop("__part", "__fine", "__short")


def _offsets(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    per_bucket = df.groupBy(*cols(keys), col("__bucket")).agg(amount.alias("__amount"))
    before = (
        Window.partitionBy(*(cols(keys) or [F.lit(0)]))
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(*cols(keys), "__bucket", F.sum("__amount").over(before).alias("__offset"))
    return offsets.where(F.col("__offset") != 0)


def _with_offset(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Only groups that fill more than one bucket have offsets; without any, the join is dropped at run time."""
    joined = null_safe_join(df, _offsets(df, keys, amount), [*keys, "__bucket"], "left")
    return joined.withColumn("__offset", F.coalesce("__offset", F.lit(0)))


def _in_bucket(keys: Sequence[str], order_by: str):
    return Window.partitionBy(*cols(keys), "__bucket").orderBy(col(order_by))


def group_ordinals(
    df: DataFrame, keys: Sequence[str], order_by: str, name: str, width: int = BUCKET_VALUES
) -> DataFrame:
    """0-based position of every row in its group, by an order column unique in the group."""
    joined = _with_offset(_with_bucket(df, order_by, width), keys, F.count(F.lit(1)))
    position = F.row_number().over(_in_bucket(keys, order_by)) - 1 + F.col("__offset")
    return joined.withColumn(name, position.cast("bigint")).drop("__bucket", "__offset")


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: str, value: str, name: str, width: int = BUCKET_VALUES
) -> DataFrame:
    """Sum of ``value`` up to and including the row, by an order column unique in the group."""
    joined = _with_offset(_with_bucket(df, order_by, width), keys, F.sum(col(value)))
    local = F.sum(col(value)).over(_in_bucket(keys, order_by).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(name, F.col("__offset") + F.coalesce(local, F.lit(0))).drop("__bucket", "__offset")


def dense_codes(
    df: DataFrame, value: str, name: str, keys: Sequence[str] = (), order_by: str | None = None
) -> DataFrame:
    """0-based code of each distinct value, null is -1.

    With ``order_by`` (a unique row position) codes follow first appearance, else
    the order of the values. ``keys`` restarts the codes in every group.
    """
    known = df.where(col(value).isNotNull())
    if order_by is None:
        values, order = known.select(*cols(keys), col(value)).distinct(), value
    else:
        values = known.groupBy(*cols(keys), col(value)).agg(F.min(col(order_by)).alias("__first"))
        order = "__first"
    codes = group_ordinals(values, keys, order, name).select(*cols(keys), col(value), col(name))
    coded = null_safe_join(df, codes, [*keys, value], "left")
    return coded.withColumn(name, F.coalesce(col(name), F.lit(-1).cast("bigint")))


def cycle(code: Column, palette: Sequence[str]) -> Column:
    """Entry ``code mod n`` of a palette; null for the null code."""
    return F.when(code >= 0, F.get(F.array(*map(F.lit, palette)), (code % len(palette)).cast("int")))


def row_suffix(df: DataFrame, keys: Sequence[str], metric: str, order_by: str, name: str) -> DataFrame:
    """``metric_i`` for the i-th of several rows of a metric in a group, ``metric`` for a single one."""
    group = [*keys, metric]
    numbered = group_ordinals(df, group, order_by, "__i")
    sizes = df.groupBy(*cols(group)).agg(F.count(F.lit(1)).alias("__n"))
    sized = null_safe_join(numbered, sizes, group)
    text = F.when(F.col("__n") > 1, F.concat_ws("_", col(metric), F.col("__i"))).otherwise(col(metric))
    return sized.withColumn(name, text).drop("__i", "__n")
