"""Chart transformations in long form: performance, relative performance, speedup."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import (
    col,
    cols,
    data_type,
    explode_rows,
    null_safe_join,
    python_text,
    require_columns,
)
from gaugeframe.operators.aggregates import reduce_dimensions
from gaugeframe.operators.filters import filter_and_relabel

OPTIMAL = "optimal"
HALF_OPTIMAL = "half-optimal"


@dataclass(frozen=True)
class Axes:
    """Columns of a chart. The index of a cell is secondary, x, then the extra axes."""

    x: str
    color: str = "perfvalue"
    y: str = "value"
    secondary: str | None = None
    extras: tuple[str, ...] = ()
    labels: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    @property
    def outer(self) -> list[str]:
        return [*([self.secondary] if self.secondary else []), *self.extras]

    @property
    def index(self) -> list[str]:
        return [*([self.secondary] if self.secondary else []), self.x, *self.extras]

    def names(self) -> list[str]:
        return [*self.index, self.color, self.y]


Steps = Sequence[tuple[str, str]]


def performance(df: DataFrame, axes: Axes, steps: Steps = (), order_by: str | None = None) -> DataFrame:
    """Filter and relabel every axis, reduce the other dimensions, give ``(index…, color, y)`` rows.

    A cell with more than one row is an error. After a grouping step cells are
    unique already, so the check costs a shuffle only on data that was not reduced.
    """
    require_columns(df, axes.names())
    for name in axes.names():
        df = filter_and_relabel(df, name, axes.labels.get(name, {}))
    keys = [*axes.index, axes.color]
    present = [(c, fn) for c, fn in steps if any(p in df.columns for p in c.split("|"))]
    reduced = reduce_dimensions(df, keys, axes.y, present, order_by)
    if not any(not fn.startswith("filter:") for _, fn in present):
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several rows for one cell; add an aggregation")))
        reduced = reduced.groupBy(*cols(keys)).agg(once.otherwise(F.first(col(axes.y))).alias(axes.y))
    return reduced.select(*cols(keys), col(axes.y))


def relative_performance(df: DataFrame, axes: Axes, steps: Steps = (), order_by: str | None = None) -> DataFrame:
    """Share of each series in the sum of its index row, in percent; null where the sum is 0."""
    cells = performance(df, axes, steps, order_by)
    totals = cells.groupBy(*cols(axes.index)).agg(F.sum(col(axes.y)).alias("__total"))
    joined = null_safe_join(cells, totals, axes.index)
    share = 100 * F.try_divide(col(axes.y).cast("double"), F.col("__total"))
    return joined.select(*cols(axes.index), col(axes.color), share.alias(axes.y))


def speedup(df: DataFrame, axes: Axes, steps: Steps = (), order_by: str | None = None) -> DataFrame:
    """``y`` at the smallest x over ``y``, with the two guide series.

    The smallest x belongs to the outer group (secondary and extra axes), not to
    the series: a series without a row there has no base and gives null. Base
    values come from grouped minima, so a hot outer group is pre-aggregated and
    never lands in one window. ``optimal`` is x over the smallest x and
    ``half-optimal`` half its gain; every cell gives both and the copies are
    merged, which is cheaper than reading the data again for them.
    """
    cells = performance(df, axes, steps, order_by).where(col(axes.x).isNotNull())
    outer = axes.outer
    start = F.struct(F.min(col(axes.x)).alias("x"), F.min_by(col(axes.y), col(axes.x)).alias("y"))
    starts = cells.groupBy(*cols(outer), col(axes.color)).agg(start.alias("__start"))
    lowest = starts.groupBy(*cols(outer)).agg(F.min("__start").alias("__lowest"))
    started = null_safe_join(cells, starts, [*outer, axes.color])
    bases = null_safe_join(started, lowest, outer) if outer else started.withColumn("__lowest", lowest.scalar())

    x, y = col(axes.x).cast("double"), col(axes.y).cast("double")
    base = F.when(F.col("__start.x") == F.col("__lowest.x"), F.col("__start.y")).cast("double")
    optimal = F.try_divide(x, F.col("__lowest.x").cast("double"))
    series = python_text(col(axes.color), data_type(cells, axes.color))
    line = lambda name, value, guide: F.struct(name.alias("s"), value.alias("v"), F.lit(guide).alias("guide"))
    lines = F.array(
        line(series, F.try_divide(base, y), 0),
        line(F.lit(OPTIMAL), optimal, 1),
        line(F.lit(HALF_OPTIMAL), (optimal - 1) / 2 + 1, 1),
    )
    points = explode_rows(bases, cols(axes.index), lines, "__line")
    points = points.select(*cols(axes.index), F.col("__line.s").alias(axes.color), F.col("__line.v").alias(axes.y), F.col("__line.guide").alias("__guide"))
    # A guide has a row for each series; it wins over a series that has its name.
    return points.groupBy(*cols(axes.index), col(axes.color)).agg(F.max_by(col(axes.y), F.col("__guide")).alias(axes.y))


TRANSFORMATIONS: dict[str, Callable[..., DataFrame]] = {
    "performance": performance,
    "relative_performance": relative_performance,
    "speedup": speedup,
}


def transform(df: DataFrame, name: str, axes: Axes, steps: Steps = (), order_by: str | None = None) -> DataFrame:
    if name not in TRANSFORMATIONS:
        raise ValueError(f"unknown transformation: {name}")
    return TRANSFORMATIONS[name](df, axes, steps, order_by)
