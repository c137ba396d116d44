"""A declarative chart request: axes with filters, reductions, a transformation, chart types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from gaugeframe.operators.series import SERIES, chart_series
from gaugeframe.operators.transforms import TRANSFORMATIONS, Axes, transform
from gaugeframe.operators.aggregates import FUNCTIONS
from gaugeframe.plans.table_options import discover_levels

# The axes a chart takes when its request names none.
DEFAULT_Y = {"parameter": "value", "label": "Value"}
DEFAULT_COLOR = {"parameter": "perfvalue", "label": "Performance Variables"}


def axis_labels(given: str | Sequence[Any] | Mapping[str, str] | None) -> dict[str, str]:
    """Axis filter as ``{value: label}``: a value, a list, a mapping or a list of mappings."""
    if not given:
        return {}
    if isinstance(given, str):
        return {given: given}
    if isinstance(given, Mapping):
        return dict(given)
    merged: dict[str, str] = {}
    for item in given:
        merged.update(item if isinstance(item, Mapping) else {item: item})
    return merged


def default_label(parameter: str) -> str:
    return parameter.title()


@dataclass(frozen=True)
class Plot:
    title: str
    kinds: Sequence[str]
    axes: Axes
    axis_titles: Mapping[str, str]
    transformation: str = "performance"
    steps: Sequence[tuple[str, str]] = ()

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Plot:
        transformation = config.get("transformation") or "performance"
        if transformation not in TRANSFORMATIONS:
            raise ValueError(f"unknown transformation: {transformation}")
        unknown = [k for k in config["plot_types"] if k not in SERIES]
        if unknown:
            raise ValueError(f"unknown chart types: {unknown}")
        steps = [(a["column"], a["agg"]) for a in config.get("aggregations") or []]
        for _, function in steps:
            if function not in FUNCTIONS and function != "median" and not function.startswith("filter:"):
                raise ValueError(f"unknown aggregation: {function}")
        named = {
            "x": config["xaxis"],
            "secondary": config.get("secondary_axis"),
            "color": {**DEFAULT_COLOR, **(config.get("color_axis") or {})},
            "y": {**DEFAULT_Y, **(config.get("yaxis") or {})},
        }
        extras = config.get("extra_axes") or []
        all_axes = [a for a in [*named.values(), *extras] if a]
        axes = Axes(
            x=named["x"]["parameter"],
            color=named["color"]["parameter"],
            y=named["y"]["parameter"],
            secondary=named["secondary"]["parameter"] if named["secondary"] else None,
            extras=tuple(a["parameter"] for a in extras),
            labels={a["parameter"]: axis_labels(a.get("filter")) for a in all_axes},
        )
        titles = {a["parameter"]: a.get("label") or default_label(a["parameter"]) for a in all_axes}
        return cls(config["title"], config["plot_types"], axes, titles, transformation, steps)


def check_axes(plot: Plot, available: Sequence[str]) -> None:
    """Every axis is a parameter, a field of one, a metric name or its value."""
    allowed = {*available, "perfvalue", "value"}
    missing = [n for n in plot.axes.names() if n not in allowed]
    if missing:
        raise ValueError(f"axes {missing} are not among {sorted(allowed)}")


def plot_cells(df: DataFrame, plot: Plot, order_by: str | None = None) -> DataFrame:
    return transform(df, plot.transformation, plot.axes, plot.steps, order_by)


def plot_series(df: DataFrame, plot: Plot, order_by: str | None = None) -> dict[str, DataFrame]:
    """The rows of every chart type of a request, all from the same cells; an axis that the table doesn't have fails."""
    check_axes(plot, df.columns)
    cells = plot_cells(df, plot, order_by)
    level_columns = {"table": plot.axes.color, "heatmap": plot.axes.x}
    return {
        kind: chart_series(
            kind, cells, plot.axes, plot.transformation,
            discover_levels(cells, [level_columns[kind]]) if kind in level_columns else (),
        )
        for kind in plot.kinds
    }
