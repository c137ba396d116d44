"""A whole report request: its data fields, and the rows of every table, chart and text in it."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.text import fill_text
from gaugeframe.operators.columns import layout
from gaugeframe.plans.fields import Field, Fields
from gaugeframe.plans.plots import Plot, plot_series
from gaugeframe.sources.readers import read_raw, relaxed_json


def read_request(spark: SparkSession, path: str) -> dict[str, Any]:
    """A request file: JSON that may have comments and trailing commas."""
    text = read_raw(spark, path).select(relaxed_json(F.col("value"))).first()[0]
    return json.loads(text)


def merge_defaults(defaults: Sequence[Mapping[str, Any]], own: Sequence[Mapping[str, Any]]) -> list[Mapping[str, Any]]:
    """Default fields, then the own fields that do not repeat one."""
    return [*defaults, *[f for f in own if f not in defaults]]


def nodes(contents: Sequence[Mapping[str, Any]]) -> Iterator[Mapping[str, Any]]:
    """Tables, charts and texts in page order; sections and grids are opened."""
    for node in contents:
        if "contents" in node:
            yield from nodes(node["contents"])
        else:
            yield node


def report_data(
    spark: SparkSession, request: Mapping[str, Any], defaults: Sequence[Mapping[str, Any]] = ()
) -> tuple[Fields, list[tuple[str, str, DataFrame]]]:
    """The fields and ``(type, title, rows)`` of every node; all lazy, but for fields that several nodes read, which are stored."""
    contents = list(nodes(request.get("contents", [])))
    # Every chart type of a plot reads its table.
    sinks = [node["ref"] for node in contents if node.get("ref") for _ in (node["plot"]["plot_types"] if node["type"] == "plot" else [0])]
    fields = Fields(spark, map(Field.from_config, merge_defaults(defaults, request.get("data", []))), sinks)
    shown = []
    for node in contents:
        if node["type"] == "table":
            arrangement = node.get("layout") or {}
            table = layout(fields.resolve(node["ref"]), arrangement.get("column_order"), arrangement.get("rename"))
            shown.append(("table", node.get("caption") or node["ref"], table))
        elif node["type"] == "plot":
            plot = Plot.from_config(node["plot"])
            for kind, rows in plot_series(fields.resolve(node["ref"]), plot).items():
                shown.append((kind, plot.title, rows))
        elif node["type"] == "text":
            data = fields.resolve(node["ref"]) if node.get("ref") else spark.sql("SELECT parse_json('{}') AS value")
            if data.schema["value"].dataType.typeName() == "string":
                data = data.select(F.parse_json(F.to_json(F.struct(F.col("value").alias(node["ref"])))).alias("value"))
            filled = data.select(fill_text(node["text"], F.col("value")).alias("text"))
            shown.append(("text", node["text"], filled))
    return fields, shown


def plugin_columns(df: DataFrame, plugins: Sequence) -> DataFrame:
    """Run pre-render plugins in order; a later plugin replaces columns of the same name."""
    for plugin in plugins:
        df = df.transform(plugin)
    return df
