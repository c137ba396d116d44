"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import store


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges u-v with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it can reach, for every node in ``links`` (a, b).

    Every step keeps the components and brings each node nearer to its smallest
    member; the number of rounds grows with the logarithm of the longest path.
    Neighbours are never gathered, so a node may have any number of them.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: the larger neighbours of u move to the least.
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the least of them.
        near = _with_least(store(large, "edges"))
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        edges = store(small.distinct(), "edges")
        # Done when every edge goes straight to a node that has no smaller neighbour.
        if not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1):
            break
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    tops = edges.select(F.col("v").alias("u")).distinct().withColumn("label", F.col("u"))
    return store(labels.union(tops).withColumnRenamed("u", "node"), "labels")
