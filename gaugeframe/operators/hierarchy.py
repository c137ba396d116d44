"""A hierarchy as a path table: one row per leaf, one column per level."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, require_columns
from gaugeframe.operators.columns import flatten_document


def mapping_paths(
    df: DataFrame, document: str, levels: Sequence[str], keys: Sequence[str] = (), separator: str = "\x1f"
) -> DataFrame:
    """Nested ``{node: {node: {…leaf}}}`` documents to path rows.

    An object with a scalar in it is a leaf: its scalars go to the ``leaf`` map
    and the names above it to the level columns. A leaf above the last level
    leaves the deeper columns null.
    """
    flat = flatten_document(df, document, keys, separator=separator)
    parts = F.split("path", separator)
    above = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), separator)
    entry = F.struct(F.element_at(parts, -1).alias("key"), F.col("value").alias("value"))
    leaves = (
        flat.select(*cols(keys), above.alias("__path"), entry.alias("__entry"))
        .groupBy(*cols(keys), "__path")
        .agg(F.map_from_entries(F.collect_list("__entry")).alias("leaf"))
    )
    names = F.split("__path", separator)
    return leaves.select(*cols(keys), *[F.get(names, F.lit(i)).alias(n) for i, n in enumerate(levels)], "leaf")


def level_order(paths: DataFrame, levels: Sequence[str], catalogue: DataFrame, node: str, kind: str) -> DataFrame:
    """Component kinds in the order they are met on the way down: ``(kind, depth)``.

    Node names are reduced to distinct ``(node, depth)`` pairs before the join.
    """
    entries = F.explode(
        F.array(*[F.struct(col(c).cast("string").alias("node"), F.lit(i).alias("depth")) for i, c in enumerate(levels)])
    )
    nodes = paths.select(entries.alias("e")).select("e.node", "e.depth").where("node is not null")
    first = nodes.groupBy("node").agg(F.min("depth").alias("depth"))
    known = catalogue.select(col(node).cast("string").alias("node"), col(kind).alias("kind"))
    return first.join(known, "node").groupBy("kind").agg(F.min("depth").alias("depth"))


def path_strings(paths: DataFrame, levels: Sequence[str], leaf: str) -> DataFrame:
    """Leaf id, parent path and the depth of every leaf; levels are joined by ``-``."""
    require_columns(paths, [*levels, leaf])
    parent = F.concat_ws("-", *[col(c).cast("string") for c in levels])
    present = sum(F.when(col(c).isNotNull(), 1).otherwise(0) for c in levels)
    leaf_id = F.concat_ws("-", parent, col(leaf).cast("string"))
    return paths.select("*", parent.alias("parent_path"), leaf_id.alias("leaf_id"), (present + 1).alias("depth"))


def nodes_of(paths: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Every inner node once with its parent and the number of leaves below it."""
    counted = paths.groupBy(*cols(levels)).agg(F.count(F.lit(1)).alias("leaves"))
    totals = counted.rollup(*cols(levels)).agg(
        F.sum("leaves").alias("leaves"), F.bit_count(F.grouping_id()).cast("int").alias("__rolled")
    )
    depth = F.lit(len(levels)) - F.col("__rolled")
    parts = F.array(*[col(c).cast("string") for c in levels])
    name = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")
    return totals.where(depth > 0).select(
        depth.alias("depth"), name(depth).alias("node"), name(depth - 1).alias("parent"), "leaves"
    )


def permute_levels(paths: DataFrame, levels: Sequence[str], order: Sequence[int], leaf: str) -> DataFrame:
    """Path rows with the levels in a new order; positions past the depth are skipped."""
    kept = [levels[i] for i in order if i < len(levels)]
    return paths.select(*[col(c).alias(f"level_{i + 1}") for i, c in enumerate(kept)], col(leaf)).distinct()


def roll_up(paths: DataFrame, levels: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Aggregates of every node over all leaves below it; ``depth`` 0 is the root."""
    return roll_up_views(paths, [levels], aggregates).drop("view")


def roll_up_views(
    paths: DataFrame, views: Sequence[Sequence[str]], aggregates: Mapping[str, Column]
) -> DataFrame:
    """The same roll-up for several level orders with one pass over the leaves.

    The prefixes of every view are the grouping sets. A prefix two views share,
    such as the root, is aggregated once and reported for each of them.
    """
    levels = list(dict.fromkeys(level for view in views for level in view))
    wanted: dict[frozenset[str], list[tuple[int, int]]] = {}
    for number, view in enumerate(views):
        for depth in range(len(view) + 1):
            wanted.setdefault(frozenset(view[:depth]), []).append((number, depth))
    sets = [[col(c) for c in levels if c in prefix] for prefix in wanted]
    grouped = paths.groupingSets(sets, *cols(levels)).agg(
        F.grouping_id().alias("__set"), *[a.alias(n) for n, a in aggregates.items()]
    )
    bit = {c: 1 << (len(levels) - 1 - i) for i, c in enumerate(levels)}
    report = F.lit(None).cast("array<struct<view:int,depth:int>>")
    for prefix, places in wanted.items():
        number = sum(bit[c] for c in levels if c not in prefix)
        shown = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(d).alias("depth")) for v, d in places])
        report = F.when(F.col("__set") == number, shown).otherwise(report)
    placed = grouped.withColumn("__at", F.explode(report))
    return placed.select(F.col("__at.view"), F.col("__at.depth"), *cols(levels), *cols(aggregates))


def roll_up_with(
    paths: DataFrame, levels: Sequence[str], callback: Callable[[str | None], Mapping[str, Column]]
) -> dict[str, DataFrame]:
    """Roll-up whose aggregates depend on the level: ``callback(level)`` names them, None is the root."""
    tables = {}
    for depth in range(len(levels) + 1):
        level = levels[depth - 1] if depth else None
        tables[level or "root"] = paths.groupBy(*cols(levels[:depth])).agg(
            *[a.alias(n) for n, a in callback(level).items()]
        )
    return tables


def fold_up(
    paths: DataFrame, levels: Sequence[str], leaves: Mapping[str, Column], callback: Callable[[str | None], Mapping[str, Column]]
) -> dict[str, DataFrame]:
    """Results passed up the hierarchy, level by level: a node sees those of its children.

    ``leaves`` are the results of the lowest level, aggregated over its leaves. ``callback(level)`` gives the results of
    every higher level as aggregates over the rows of its children, whose results and name are columns;
    None is the root. Names a level doesn't give again are not passed on. The leaves are grouped once; every further level works on the few
    nodes below it, and no node's children are gathered.
    """
    tables = {levels[-1]: paths.groupBy(*cols(levels)).agg(*[a.alias(n) for n, a in leaves.items()])}
    below = tables[levels[-1]]
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth - 1] if depth else None
        below = below.groupBy(*cols(levels[:depth])).agg(*[a.alias(n) for n, a in callback(level).items()])
        tables[level or "root"] = below
    return tables


def upsert_catalogue(
    current: DataFrame, executions: DataFrame, keys: Sequence[str], order_by: str, path: str, title: str
) -> DataFrame:
    """Latest path per key; the title is the first one given and is never replaced."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(executions.withColumn("__new", F.lit(1)), True)
    order = F.struct("__new", col(order_by))
    return rows.groupBy(*cols(keys)).agg(
        F.max_by(col(path), order).alias(path),
        F.min_by(col(title), F.when(col(title).isNotNull(), order)).alias(title),
    )

