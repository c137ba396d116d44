"""Projections: computed, graded and link columns, layout, prefixes, nested flattening."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, explode_rows, require_columns, variant_text
from gaugeframe.functions.nested import entry, nesting_bound, unfold


def computed_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Add ``name -> SQL expression`` in order; later expressions see earlier columns."""
    for name, sql in expressions.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def grade_column(df: DataFrame, name: str, column: str, bounds: Sequence[tuple[float, Any]], otherwise: Any) -> DataFrame:
    """Label of the first lower bound the value reaches, else ``otherwise``."""
    graded = None
    for bound, label in bounds:
        test = col(column) >= F.lit(bound)
        graded = F.when(test, label) if graded is None else graded.when(test, label)
    return df.withColumn(name, graded.otherwise(otherwise))


def link_column(df: DataFrame, name: str, key: str, target: str, label: str) -> DataFrame:
    """``link:<target>[<label>]`` where ``{}`` in the target is the key of the row."""
    before, after = target.split("{}", 1)
    link = F.concat(F.lit(f"link:{before}"), col(key).cast("string"), F.lit(f"{after}[{label}]"))
    return df.withColumn(name, link)


def layout(df: DataFrame, order: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Select the ordered columns the table has, then rename them."""
    if order is not None:
        df = df.select(*cols(c for c in order if c in df.columns))
    return df.withColumnsRenamed(dict(rename)) if rename else df


def prefix_columns(df: DataFrame, prefix: str, only: Sequence[str] | None = None) -> DataFrame:
    names = df.columns if only is None else only
    require_columns(df, names)
    return df.select(*[col(c).alias(prefix + c) if c in names else col(c) for c in df.columns])


def attach_constant(df: DataFrame, name: str, value: Any) -> DataFrame:
    """Give every row the id of the parent it belongs to."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def flatten_document(
    df: DataFrame,
    document: str,
    keys: Sequence[str],
    separator: str = ".",
    parent: str = "",
    depth: int | None = None,
    kinds: bool = False,
) -> DataFrame:
    """One ``(keys, path, value)`` row per scalar of a JSON document, with its ``kind`` on demand.

    List items are named by their index; empty lists and objects give no row. The walk is one
    expression and one generator, for any depth and for streams too; no job runs while the plan is
    built. With ``depth``, deeper input fails.
    """
    is_text = df.schema[document].dataType.typeName() == "string"
    node = F.parse_json(col(document)) if is_text else col(document)
    most = nesting_bound(col(document) if is_text else F.to_json(col(document)))
    read = df.select(*cols(keys), node.alias("__node"), (most if depth is None else F.lit(depth)).alias("__most"))
    step = lambda path, part: F.when(path == "", part).otherwise(F.concat(path, F.lit(separator), part))
    deep = None if depth is None else F.lit(f"document deeper than {depth} levels")
    found = unfold(F.array(entry(F.lit(0), F.lit(parent), F.col("__node"))), F.col("__most"), step, step, too_deep=deep)
    rows = explode_rows(read, cols(keys), found, "m").where(F.col("m.path") != parent)
    extra = [F.schema_of_variant("m.node").alias("kind")] if kinds else []
    return rows.select(*cols(keys), F.col("m.path").alias("path"), variant_text(F.col("m.node")).alias("value"), *extra)
