"""Unions, ordered distinct, merges and reshapes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, explode_rows, null_safe_join, variant_text
from gaugeframe.functions.nested import canonical_digest, entry, fields_of, items_of, nesting_bound, truthy, unfold
from gaugeframe.operators.aggregates import spread
from gaugeframe.operators.ordinals import group_ordinals
from gaugeframe.session import scratch_dir


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_distinct(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """First row of each distinct key, by a unique row position; copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*cols(rest)), col(order_by)).alias("__first")
    return df.groupBy(*cols(keys)).agg(first).select(*cols(keys), *[F.col("__first")[c].alias(c) for c in rest])


def with_defaults(defaults: DataFrame, own: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Defaults, then the own rows that do not repeat a default."""
    extra = own.join(defaults, list(on), "left_anti")
    return defaults.withColumn(flag, F.lit(True)).unionByName(extra.withColumn(flag, F.lit(False)))


SEPARATOR = "\x1f"


def _above(path: Column) -> Column:
    """The paths of the objects that hold a path."""
    parts = F.split(path, SEPARATOR)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def _writes(df: DataFrame, document: str, keys: Sequence[str], order_by: str, keep_empty: bool) -> DataFrame:
    """A row per scalar, list and empty object of every document, in the objects that hold it."""
    is_text = df.schema[document].dataType.typeName() == "string"
    node = F.parse_json(col(document)) if is_text else col(document)
    most = nesting_bound(col(document) if is_text else F.to_json(col(document)))
    read = df.select(*cols(keys), col(order_by).alias("__order"), node.alias("__node"), most.alias("__most"))
    step = lambda path, key: F.when(path == "", key).otherwise(F.concat(path, F.lit(SEPARATOR), key))
    found = unfold(F.array(entry(F.lit(0), F.lit(""), F.col("__node"))), F.col("__most"), step, step, into_lists=False, keep_hollow=True)
    rows = explode_rows(read, [*cols(keys), "__order", "__most"], found, "m").where(F.col("m.path") != "")
    kind = F.when(items_of(F.col("m.node")).isNotNull(), "list").when(fields_of(F.col("m.node")).isNotNull(), "object").otherwise("scalar")
    filled = F.lit(True) if keep_empty else truthy(F.col("m.node"))
    return rows.select(*cols(keys), "__order", "__most", F.col("m.path").alias("__path"), F.col("m.node").alias("__node"), kind.alias("kind"), filled.alias("__filled"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_documents(df: DataFrame, document: str, keys: Sequence[str], order_by: str, keep_empty: bool = False) -> DataFrame:
    """The documents of each key merged in the order of a unique column: ``(keys, path, position, value, kind)`` rows.

    Objects are merged key by key. A scalar replaces what was there, an object or list too, and
    the other way round. Two lists make one with the distinct items of both, by first appearance; items may be of any
    shape and are equal as in Python (the order of keys doesn't count, ``1`` is ``1.0`` and ``true``); a list that met no other keeps its
    repeated items. An empty value (null, false, 0, empty text, list or object; not the text ``0``) is
    taken only where nothing is yet. With ``keep_empty`` empty values replace like others, lists are replaced whole, and an
    empty object leaves an object as it is.

    ``path`` joins the keys by points; list items have a row each with their ``position``; ``kind`` is scalar, list (an item)
    or object (empty). Nested items are JSON texts, empty lists and objects ``[]`` and ``{}``. A document that is null or no object
    gives nothing. No rows of a key or path are gathered in one place, so a path may be written by any number of documents.
    """
    place = [*keys, "__path"]
    # The walks through the documents are done once: the steps below read what they found some six times.
    writes = _stored(_writes(df, document, keys, order_by, keep_empty), "merge-writes")
    solid = F.col("__filled") & (F.col("kind") != "object")
    # A value in place of an object ends what was written below it before.
    resets = writes.where(solid).groupBy(*cols(keys), F.col("__path").alias("__above")).agg(F.max("__order").alias("__reset"))
    paths = writes.select(*cols(place)).distinct()
    above = explode_rows(paths, cols(place), _above(F.col("__path")), "__above")
    ended = null_safe_join(above, resets, [*keys, "__above"]).groupBy(*cols(place)).agg(F.max("__reset").alias("__ended"))
    alive = null_safe_join(writes, ended, place, "left").where(F.col("__ended").isNull() | (F.col("__order") > F.col("__ended"))).drop("__ended")
    # An object in place of a value ends that; empty values don't come where an object is.
    lasts = alive.groupBy(*cols(place)).agg(F.max("__order").alias("__last"))
    objects = explode_rows(lasts, [*cols(place), "__last"], _above(F.col("__path")), "__above")
    objects = objects.groupBy(*cols(keys), F.col("__above").alias("__path")).agg(F.max("__last").alias("__object"))
    left = null_safe_join(alive, objects, place, "left").where(F.col("__object").isNull() | (solid & (F.col("__order") > F.col("__object"))))

    value = F.when(F.col("kind") == "scalar", variant_text(F.col("__node"))).otherwise(F.to_json("__node"))
    shown = F.struct("kind", value.alias("value"))
    joins = F.lit(not keep_empty) & (F.col("kind") == "list")
    tops = left.groupBy(*cols(place)).agg(
        F.max_by(shown, F.when(F.col("__filled"), F.col("__order"))).alias("__top"),
        F.min_by(shown, F.when(~F.col("__filled"), F.col("__order"))).alias("__first"),
        F.max(F.when(F.col("__filled") & ~joins, F.col("__order"))).alias("__since"),
        F.max(F.when(F.col("__filled") & joins, F.col("__order"))).alias("__list"),
    )
    name = F.replace(F.col("__path"), F.lit(SEPARATOR), F.lit(".")).alias("path")
    is_list = F.col("__list").isNotNull() & (F.col("__since").isNull() | (F.col("__list") > F.col("__since")))
    winner = F.coalesce("__top", "__first")
    hollow = (winner["kind"] == "list") & (winner["value"] == "[]")
    single = tops.where(~is_list).select(*cols(keys), name, F.lit(None).cast("bigint").alias("position"), winner["value"].alias("value"), winner["kind"].alias("kind"), (~hollow & (winner["kind"] == "list")).alias("__whole"))
    plain = single.where(~F.col("__whole")).drop("__whole")

    # The lists since the last value that was none; with several, each distinct item once.
    runs = null_safe_join(left.where(F.col("__filled") & (F.col("kind") == "list")), tops.where(is_list).select(*cols(place), "__since"), place)
    runs = runs.where(F.col("__since").isNull() | (F.col("__order") > F.col("__since")))
    if keep_empty:
        replaced = tops.where(winner["kind"] == "list").select(*cols(place), F.col("__since").alias("__last"))
        runs = null_safe_join(left.where(F.col("kind") == "list"), replaced, place).where(F.col("__order") == F.col("__last"))
    several = runs.groupBy(*cols(place)).agg(F.count(F.lit(1)).alias("__lists"))
    items = explode_rows(runs, [*cols(place), "__order", "__most"], items_of(F.col("__node")), "__item", "__at")
    spelt = F.when(fields_of(F.col("__item")).isNotNull() | items_of(F.col("__item")).isNotNull(), F.to_json("__item")).otherwise(variant_text(F.col("__item")))
    items = null_safe_join(items, several, place).select(
        *cols(place), F.struct("__order", "__at").alias("__first"), spelt.alias("value"),
        F.when(F.col("__lists") > 1, canonical_digest(F.col("__item"), F.col("__most"))).otherwise(F.col("__at").cast("string")).alias("__digest"),
    )
    firsts = items.groupBy(*cols(place), "__digest").agg(F.min("__first").alias("__first"), F.min_by("value", "__first").alias("value"))
    # The digests of nested items are as dear, and positions read their rows several times.
    placed = group_ordinals(_stored(firsts, "merge-items"), place, "__first", "position")
    return plain.unionByName(placed.select(*cols(keys), name, "position", "value", F.lit("list").alias("kind")))


def merge_lists(items: DataFrame, keys: Sequence[str], item: str, order_by: str) -> DataFrame:
    """Distinct list items of merged documents with their position by first appearance."""
    firsts = items.groupBy(*cols(keys), col(item)).agg(F.min(col(order_by)).alias(order_by))
    return group_ordinals(firsts, keys, order_by, "position")


def melt(
    df: DataFrame, index: Sequence[str], values: Sequence[str], series: str = "series", value: str = "value"
) -> DataFrame:
    return df.unpivot(cols(index), cols(values), series, value)


def transpose(df: DataFrame, index: str, levels: Sequence[Any], name: str) -> DataFrame:
    """Rows become columns; ``levels`` are the index values that become the new columns."""
    rest = [c for c in df.columns if c != index]
    return spread(melt(df, [index], rest, name, "__cell"), [name], index, "__cell", levels)
