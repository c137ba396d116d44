"""A declarative table request: filter, compute, pivot or group, sort, format, in that order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import cols
from gaugeframe.functions.scalars import format_columns
from gaugeframe.operators.aggregates import group_rows, pivot_table, sort_rows
from gaugeframe.operators.columns import computed_columns
from gaugeframe.operators.filters import CONDITIONS, filter_rows


@dataclass(frozen=True)
class Pivot:
    index: Sequence[str]
    columns: Sequence[str]
    values: str
    agg: str
    levels: Sequence[Any] | None = None


@dataclass(frozen=True)
class GroupBy:
    columns: Sequence[str]
    agg: Mapping[str, str] | str


@dataclass(frozen=True)
class TableOptions:
    filter: Sequence[tuple[str, str, Any]] = ()
    computed_columns: Mapping[str, str] = field(default_factory=dict)
    pivot: Pivot | None = None
    group_by: GroupBy | None = None
    sort: Sequence[tuple[str, bool]] = ()
    format: Mapping[str, str | Mapping[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.group_by and self.pivot:
            raise ValueError("a pivot already aggregates: give either group_by or pivot")
        if self.group_by and not self.group_by.agg:
            raise ValueError("group_by needs an aggregation")
        if self.pivot and self.sort:
            raise ValueError("sort before the pivot: the order of a pivoted table is ambiguous")
        for _, op, _ in self.filter:
            if op not in CONDITIONS:
                raise ValueError(f"unknown filter operator: {op}")

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> TableOptions:
        known = {"filter", "computed_columns", "pivot", "group_by", "sort", "format"}
        if set(config) - known:
            raise ValueError(f"unknown table options: {sorted(set(config) - known)}")
        return cls(
            filter=[(f["column"], f["op"], f["value"]) for f in config.get("filter") or []],
            computed_columns=config.get("computed_columns") or {},
            pivot=Pivot(**config["pivot"]) if config.get("pivot") else None,
            group_by=GroupBy(**config["group_by"]) if config.get("group_by") else None,
            sort=[(s["column"], s.get("ascending", True)) for s in config.get("sort") or []],
            format=config.get("format") or {},
        )


def discover_levels(df: DataFrame, columns: Sequence[str]) -> list[Any]:
    """Sorted levels of pivot columns, for a request that does not list them.

    The levels become table columns, so there are as many as Spark allows a pivot
    to have; one more is an error, as it is for Spark's own pivot.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols(columns)])
    rows = df.where(known).select(*cols(columns)).distinct().orderBy(*cols(columns)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{columns} have more than {most} levels; too many for table columns")
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def apply_options(df: DataFrame, options: TableOptions, order_by: str | None = None) -> DataFrame:
    """Run a table request. ``order_by`` names the row position that ``first`` and ``last`` follow."""
    df = filter_rows(df, options.filter)
    df = computed_columns(df, options.computed_columns)
    if options.pivot:
        p = options.pivot
        levels = p.levels if p.levels is not None else discover_levels(df, p.columns)
        df = pivot_table(df, p.index, p.columns, p.values, p.agg, levels, order_by)
    elif options.group_by:
        df = group_rows(df, options.group_by.columns, options.group_by.agg, order_by)
    if options.sort:
        df = sort_rows(df, options.sort)
    return format_columns(df, options.format)


# The default case table and its status signs.
def parameter_table_options(key: str = "testcases.hashcode") -> TableOptions:
    """One row per test case with a link to its logs."""
    return TableOptions(
        computed_columns={"logs_link": f"concat('link:logs/', `{key}`, '.html[Logs]')"},
        group_by=GroupBy([key], "first"),
        format={"testcases.time_total": "%.3f", "result": {"pass": "🟢", "fail": "🔴", "abort": "🟠"}},
    )
