"""The rows each chart type draws, from the long cells of a transformation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.columns import col, cols, data_type, null_safe_join, text_of
from gaugeframe.operators.aggregates import spread, value_range
from gaugeframe.operators.ordinals import cycle, dense_codes, group_ordinals, running_total
from gaugeframe.operators.transforms import HALF_OPTIMAL, OPTIMAL, Axes

# Marker symbols and line colours in drawing order.
MARKS = [
    "circle", "square", "diamond", "cross", "x", "triangle-up", "triangle-down", "triangle-left", "triangle-right",
    "pentagon", "hexagon", "octagon", "star", "hexagram", "star-triangle-up", "star-triangle-down", "star-square",
    "star-diamond", "diamond-tall", "diamond-wide", "hourglass", "bowtie",
]
COLORS = [
    "red", "blue", "green", "orange", "purple", "brown", "pink", "gray", "cyan", "magenta", "yellow", "darkblue",
    "darkred", "darkgreen", "darkorange", "darkpurple", "darkbrown", "darkpink", "darkgray", "darkcyan",
    "darkmagenta", "darkyellow", "lightblue", "lightred", "lightgreen", "lightorange", "lightpurple", "lightbrown",
    "lightpink", "lightgray", "lightcyan", "lightmagenta", "lightyellow", "black",
]


def _is_guide(axes: Axes, transformation: str) -> Column:
    if transformation != "speedup":
        return F.lit(False)
    return F.coalesce(col(axes.color).isin(OPTIMAL, HALF_OPTIMAL), F.lit(False))


def _depth_axis(axes: Axes) -> str:
    """Axis of marks and of depth: the first extra axis, else the secondary one."""
    if len(axes.index) not in (2, 3):
        raise ValueError("this chart needs two or three index axes")
    return axes.extras[0] if axes.extras else axes.secondary


def scatter(cells: DataFrame, axes: Axes, transformation: str = "performance") -> DataFrame:
    """One line per series; guide lines are told apart by ``is_guide``."""
    return cells.withColumn("is_guide", _is_guide(axes, transformation))


def marked_scatter(cells: DataFrame, axes: Axes, transformation: str = "performance") -> DataFrame:
    """Scatter with a marker per value of the mark axis and a colour per series.

    Marks are numbered in a frame by first appearance in index order, colours by
    series order without the guides; both start over at the end of the palette.
    """
    mark = _depth_axis(axes)
    frame = [axes.secondary] if len(axes.index) == 3 else []
    if axes.index[0] == mark:
        coded = dense_codes(cells, mark, "mark_index", frame)
    else:
        first = cells.groupBy(*cols([*frame, mark])).agg(F.min(col(axes.x)).alias("__x"))
        first = first.withColumn("__at", F.struct(F.col("__x"), col(mark)))
        marks = group_ordinals(first, frame, "__at", "mark_index").drop("__x", "__at")
        coded = null_safe_join(cells, marks, [*frame, mark])
    guide = _is_guide(axes, transformation)
    coded = coded.withColumn("is_guide", guide).withColumn("__series", F.when(~guide, col(axes.color)))
    coded = dense_codes(coded, "__series", "color_index").drop("__series")
    return coded.withColumns({"mark": cycle(F.col("mark_index"), MARKS), "color": cycle(F.col("color_index"), COLORS)})


def significant(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double")


def table_figure(cells: DataFrame, axes: Axes, levels: Sequence[Any], digits: int = 3) -> DataFrame:
    """Index columns and one column per series, floats to three significant digits."""
    table = spread(cells, axes.index, axes.color, axes.y, levels, strict=True)
    floats = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return table.withColumns({c: significant(col(c), digits) for c in floats})


def _as_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: text_of(df, n) for n in names})


def stacked_bar(cells: DataFrame, axes: Axes) -> DataFrame:
    """Bars with x (the facet) and secondary as text and the top of each stacked part."""
    bar = [axes.x, *([axes.secondary] if axes.secondary else [])]
    return running_total(_as_text(cells, bar), [*bar, *axes.extras], axes.color, axes.y, "stack_top")


def grouped_bar(cells: DataFrame, axes: Axes) -> DataFrame:
    return _as_text(cells, [axes.x])


def heatmap(cells: DataFrame, axes: Axes, levels: Sequence[Any]) -> DataFrame:
    """Matrix with a row per series and a column per x; a frame per outer key."""
    return spread(cells, [*axes.outer, axes.color], axes.x, axes.y, levels, strict=True)


def sunburst(cells: DataFrame, axes: Axes) -> DataFrame:
    """Sum of every ring node; the path is the index, then the series."""
    path = [*axes.index, axes.color]
    return hierarchy_totals(_as_text(cells, path), path, axes.y)


def hierarchy_totals(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """``(depth, id, parent, total)`` for every prefix of the path columns, in one rollup."""
    totals = df.rollup(*cols(path)).agg(
        F.sum(col(value)).alias("total"), F.bit_count(F.grouping_id()).cast("int").alias("__rolled")
    )
    depth = F.lit(len(path)) - F.col("__rolled")
    parts = F.array(*[col(c).cast("string") for c in path])
    node = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/", "null")
    return totals.where(depth > 0).select(
        depth.alias("depth"), node(depth).alias("id"), node(depth - 1).alias("parent"), "total"
    )


def parallel_coordinates(cells: DataFrame, axes: Axes) -> DataFrame:
    """Cells whose text dimensions are replaced by codes of first appearance."""
    coded = cells.withColumn("__at", F.struct(*cols(axes.index)))
    for name in [*axes.index, axes.color]:
        if isinstance(data_type(cells, name), T.StringType):
            order = "__at" if name != axes.color and name != axes.index[0] else None
            coded = dense_codes(coded, name, f"{name}_code", order_by=order)
        else:
            coded = coded.withColumn(f"{name}_code", col(name))
    return coded.drop("__at")


def points_3d(cells: DataFrame, axes: Axes) -> DataFrame:
    """``x, y, z`` points per series, in frames of the secondary axis when there are three index axes."""
    depth = _depth_axis(axes)
    frame = [col(axes.secondary).alias("frame")] if len(axes.index) == 3 else []
    return cells.select(
        *frame, col(axes.x).alias("x"), col(depth).alias("y"), col(axes.y).alias("z"), col(axes.color).alias("series")
    )


def slider_frames(cells: DataFrame, axes: Axes) -> DataFrame:
    """One row per value of the secondary axis: frame number, name and y range."""
    ranges = value_range(cells, axes.y, [axes.secondary])
    numbered = group_ordinals(ranges.where(col(axes.secondary).isNotNull()), [], axes.secondary, "frame")
    return numbered.withColumn("name", F.concat(F.lit("frame_"), F.col("frame").cast("string")))


SERIES = {
    "scatter": lambda cells, axes, transformation, levels: scatter(cells, axes, transformation),
    "marked_scatter": lambda cells, axes, transformation, levels: marked_scatter(cells, axes, transformation),
    "table": lambda cells, axes, transformation, levels: table_figure(cells, axes, levels),
    "stacked_bar": lambda cells, axes, transformation, levels: stacked_bar(cells, axes),
    "grouped_bar": lambda cells, axes, transformation, levels: grouped_bar(cells, axes),
    "heatmap": lambda cells, axes, transformation, levels: heatmap(cells, axes, levels),
    "sunburst": lambda cells, axes, transformation, levels: sunburst(cells, axes),
    "parallelcoordinates": lambda cells, axes, transformation, levels: parallel_coordinates(cells, axes),
    "scatter3d": lambda cells, axes, transformation, levels: points_3d(cells, axes),
    "surface3d": lambda cells, axes, transformation, levels: points_3d(cells, axes),
}


def chart_series(
    kind: str, cells: DataFrame, axes: Axes, transformation: str = "performance", levels: Sequence[Any] = ()
) -> DataFrame:
    if kind not in SERIES:
        raise ValueError(f"unknown chart type: {kind}")
    return SERIES[kind](cells, axes, transformation, levels)
