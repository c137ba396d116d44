"""Grouping, pivots and ordered reductions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.columns import choose_column, col, cols, null_safe_join, require_columns
from gaugeframe.operators.filters import filter_text
from gaugeframe.operators.ordinals import running_total
from gaugeframe.session import scratch_dir


def _first(column: Column, order: Column | None) -> Column:
    return F.first(column, ignorenulls=True) if order is None else F.min_by(column, F.when(column.isNotNull(), order))


def _last(column: Column, order: Column | None) -> Column:
    return F.last(column, ignorenulls=True) if order is None else F.max_by(column, F.when(column.isNotNull(), order))


# name -> (column, row order) -> aggregate. A sum of no values is 0; first and
# last skip nulls and follow the given row order.
FUNCTIONS = {
    "sum": lambda c, o: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c, o: F.avg(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "first": _first,
    "last": _last,
    "count": lambda c, o: F.count(c),
    "nunique": lambda c, o: F.count_distinct(c),
    "size": lambda c, o: F.count(F.lit(1)),
    "std": lambda c, o: F.when(F.count(c) > 1, F.stddev_samp(c)),
    "var": lambda c, o: F.when(F.count(c) > 1, F.var_samp(c)),
    "prod": lambda c, o: F.coalesce(F.product(c), F.lit(1.0)),
}


def aggregate(function: str, column: str, order_by: str | None = None) -> Column:
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregation: {function}")
    return FUNCTIONS[function](col(column), col(order_by) if order_by else None)


def group_rows(
    df: DataFrame, keys: Sequence[str], agg: Mapping[str, str] | str, order_by: str | None = None
) -> DataFrame:
    """Group by keys with one function per column, or one for all other columns.

    Rows with a null key are dropped. ``median`` is worked out on its own because
    an exact median has no bounded partial state.
    """
    if isinstance(agg, str):
        agg = {c: agg for c in df.columns if c not in keys and c != order_by}
    require_columns(df, [*keys, *agg])
    kept = df.where(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys]))
    plain = {c: fn for c, fn in agg.items() if fn != "median"}
    medians = [c for c, fn in agg.items() if fn == "median"]
    # The first part has every group: a median has no row for a group that holds nulls only.
    made = [aggregate(fn, c, order_by).alias(c) for c, fn in plain.items()]
    parts = [kept.groupBy(*cols(keys)).agg(*made) if made else kept.select(*cols(keys)).distinct()]
    parts += [exact_median(kept, keys, c) for c in medians]
    joined = reduce(lambda a, b: null_safe_join(a, b, keys, "left"), parts)
    return joined.select(*cols(keys), *cols(agg))


def exact_median(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Exact median per group without holding a group in one task.

    Copies of a value are counted first; the bucketed running count then shows
    which one or two values hold the middle ranks.
    """
    value = col(column).cast("double")
    counts = (
        df.select(*cols(keys), value.alias("__v"))
        .where("__v is not null")
        .groupBy(*cols(keys), col("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    totals = counts.groupBy(*cols(keys)).agg(F.sum("__c").alias("__n"))
    ranked = null_safe_join(running_total(counts, keys, "__v", "__c", "__end"), totals, keys)
    holds = lambda rank: (F.col("__end") - F.col("__c") <= rank) & (rank < F.col("__end"))
    middle = ranked.where(holds(F.floor((F.col("__n") - 1) / 2)) | holds(F.floor(F.col("__n") / 2)))
    return middle.groupBy(*cols(keys)).agg(((F.min("__v") + F.max("__v")) / 2).alias(column))


def spread(
    df: DataFrame, index: Sequence[str], series: str, value: str, levels: Sequence[Any], strict: bool = False
) -> DataFrame:
    """Long rows to one column per series level; a series that is not listed fails the query, so that no row is lost.

    ``strict`` also fails on a second row for a cell.
    """
    listed = reduce(lambda a, b: a | b, [col(series).eqNullSafe(F.lit(level)) for level in levels], F.lit(False))
    other = F.raise_error(F.concat(F.lit("a series is not among the listed levels: "), F.coalesce(col(series).cast("string"), F.lit("null"))))
    checked = F.when(listed | col(series).isNull(), col(series)).otherwise(other)
    df = df.withColumn("__series", checked)
    cells = []
    for level in levels:
        cell = F.when(F.col("__series") == F.lit(level), col(value))
        picked = F.max(cell)
        if strict:
            rows = F.count(F.when(F.col("__series") == F.lit(level), 1))
            picked = F.when(rows > 1, F.raise_error(F.lit(f"several rows for one cell of series {level}"))).otherwise(picked)
        cells.append(picked.alias(str(level)))
    return df.groupBy(*cols(index)).agg(*cells)


def level_name(level: Any) -> str:
    """Name of a pivot column; the parts of several pivot columns are joined by ``_``."""
    return "_".join(map(str, level)) if isinstance(level, (tuple, list)) else str(level)


def pivot_table(
    df: DataFrame,
    index: Sequence[str],
    columns: Sequence[str],
    values: str,
    agg: str,
    levels: Sequence[Any],
    order_by: str | None = None,
) -> DataFrame:
    """Cells of ``agg(values)`` with one column per level of the pivot columns.

    The levels are given, so the plan needs no extra job and its schema does not change
    with the data; a combination that is not listed fails the query. With several
    pivot columns a level is a tuple, and its parts are compared one by one. Rows with
    a null pivot column are left out, those with a null index stay. Only observed
    rows of the index are shown, not all combinations of its levels.
    """
    known = df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns]))
    fields = [f"__k{i}" for i in range(len(index))]
    # Grouping drops null keys, so the index travels as one struct that is never null.
    keyed = known.withColumn("__index", F.struct(*[col(c).alias(f) for c, f in zip(index, fields)]))
    keyed = keyed.withColumn("__level", F.struct(*[col(c).cast("string").alias(f"l{i}") for i, c in enumerate(columns)]))
    extra = [order_by] if order_by else []
    cells = group_rows(keyed.select("__index", "__level", col(values), *cols(extra)), ["__index", "__level"], {values: agg}, order_by)
    parts = [level if isinstance(level, (tuple, list)) else (level,) for level in levels]
    is_level = [reduce(lambda a, b: a & b, [F.col("__level")[f"l{i}"] == F.lit(x).cast("string") for i, x in enumerate(p)]) for p in parts]
    number = F.coalesce(*[F.when(test, i) for i, test in enumerate(is_level)], _unlisted(F.col("__level")))
    table = spread(cells.withColumn("__n", number), ["__index"], "__n", values, range(len(levels)))
    names = [F.col(str(i)).alias(level_name(level)) for i, level in enumerate(levels)]
    return table.select(*[F.col("__index")[f].alias(c) for c, f in zip(index, fields)], *names)


def _unlisted(level: Column) -> Column:
    return F.raise_error(F.concat(F.lit("a pivot level is not listed: "), F.to_json(level))).cast("int")


def reduce_dimensions(
    df: DataFrame, keys: Sequence[str], y: str, steps: Sequence[tuple[str, str]], order_by: str | None = None
) -> DataFrame:
    """Apply ``(column, function)`` steps in order; each takes its column out of the keys.

    ``filter:VALUE`` keeps rows instead. Columns the table lacks are skipped, and
    ``a|b|c`` means the first one it has. ``first`` and ``last`` follow
    ``order_by`` on raw rows and the reduced column afterwards.
    """
    steps = [(choose_column(c, df.columns), fn) for c, fn in steps]
    steps = [(c, fn) for c, fn in steps if c is not None]
    remaining = [c for c, _ in steps]
    rows, order = df, order_by
    for column, function in steps:
        remaining.remove(column)
        if function.startswith("filter:"):
            rows = filter_text(rows, column, function)
            continue
        if order is None and rows is not df and column in rows.columns:
            order = column
        rows = group_rows(rows, list(dict.fromkeys([*keys, *remaining])), {y: function}, order)
        order = None
    return rows


def value_range(df: DataFrame, value: str, keys: Sequence[str] = (), margin: float = 0.01) -> DataFrame:
    """Axis range per frame; both margins are a share of the minimum."""
    low, high = F.min(col(value)), F.max(col(value))
    return df.groupBy(*cols(keys)).agg(
        (low - low * F.lit(margin)).alias("low"), (high + low * F.lit(margin)).alias("high")
    )


def case_counts(df: DataFrame, keys: Sequence[str], items: str, result: str) -> DataFrame:
    """Items, cases and failures per group; ``items`` is an array column."""
    return df.groupBy(*cols(keys)).agg(
        F.coalesce(F.sum(F.size(col(items))), F.lit(0)).alias("num_items"),
        F.count(F.lit(1)).alias("num_cases"),
        F.count(F.when(~col(result).eqNullSafe("pass"), 1)).alias("num_failures"),
    )


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The kept columns of the greatest row per group; a later order column settles ties."""
    newest = F.max_by(F.struct(*cols(keep)), F.struct(*cols(order))).alias("__latest")
    found = df.groupBy(*cols(keys)).agg(newest)
    return found.select(*cols(keys), *[F.col("__latest")[c].alias(c) for c in keep])


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by ``(column, ascending)``; nulls come last in both directions."""
    return df.orderBy(*[col(c).asc_nulls_last() if up else col(c).desc_nulls_last() for c, up in keys])


def sorted_positions(df: DataFrame, keys: Sequence[tuple[str, bool]], name: str) -> DataFrame:
    """The rows in the order of :func:`sort_rows`, with their place in it.

    The sorted rows are written once, so that their partitions stay the same; the
    sizes of the partitions, a row each, give the first place of every one.
    """
    path = scratch_dir(df.sparkSession, "sorted")
    placed = sort_rows(df, keys).withColumn("__id", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path).withColumn("__part", F.expr("shiftright(__id, 33)"))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    joined = rows.join(starts, "__part")
    return joined.withColumn(name, F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")
