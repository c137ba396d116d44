"""Catalogue look-ups written as equi-joins.

No side is broadcast by hand: Spark broadcasts a catalogue when its measured
size is small and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, require_columns


def known_nodes(mapping: DataFrame, catalogue: Mapping[str, DataFrame]) -> DataFrame:
    """Keep mapping rows whose node is in the catalogue at every level given.

    Dropping a row drops the subtree under the unknown node.
    """
    require_columns(mapping, catalogue)
    for level, nodes in catalogue.items():
        mapping = mapping.join(nodes, level, "left_semi")
    return mapping


def node_metadata(nodes: DataFrame, metadata: DataFrame, on: Sequence[str]) -> DataFrame:
    return nodes.join(metadata, list(on), "left")


def attach_leaves(leaves: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    return leaves.join(parents, list(on), "inner")


def orphan_leaves(leaves: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Leaves without a parent, for the warning."""
    return leaves.join(parents, list(on), "left_anti")


def with_default(nodes: DataFrame, level: DataFrame, key: str, value: str, everywhere: Any = None) -> DataFrame:
    """Own value, else that of the level, else the one for all."""
    defaults = level.select(col(key), col(value).alias("__level"))
    chosen = F.coalesce(col(value), F.col("__level"), F.lit(everywhere))
    return nodes.join(defaults, key, "left").withColumn(value, chosen).drop("__level")


def multi_key_lookup(nodes: DataFrame, node: str, keyed: DataFrame, key: str) -> DataFrame:
    """Match nodes with entries whose key ``a|b|c`` names them."""
    single = keyed.withColumn("__id", F.explode(F.array_distinct(F.split(col(key), r"\|"))))
    return nodes.join(single, col(node) == F.col("__id")).drop("__id", key)
