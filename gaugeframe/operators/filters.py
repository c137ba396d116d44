"""Row filters: conditions, axis filters with relabelling, case selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, require_columns, text_of


def _member(column: Column, values: Iterable[Any]) -> Column:
    """Membership where a null cell matches only a null in the list."""
    values = list(values)
    known = [v for v in values if v is not None]
    found = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
    return found | column.isNull() if len(known) < len(values) else found


# A null cell is unequal to every value, so it passes != and "not in" and no other test.
CONDITIONS = {
    "==": lambda c, v: F.lit(False) if v is None else c == F.lit(v),
    "!=": lambda c, v: F.lit(True) if v is None else ~c.eqNullSafe(F.lit(v)),
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "in": _member,
    "not in": lambda c, v: ~_member(c, v),
}


def condition(column: str, op: str, value: Any) -> Column:
    if op not in CONDITIONS:
        raise ValueError(f"unknown filter operator: {op}")
    return CONDITIONS[op](col(column), value)


def filter_rows(df: DataFrame, conditions: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """Keep the rows that pass every ``(column, operator, value)``."""
    require_columns(df, [c for c, _, _ in conditions])
    if not conditions:
        return df
    return df.where(reduce(lambda a, b: a & b, [condition(*c) for c in conditions]))


def filter_and_relabel(df: DataFrame, column: str, labels: Mapping[str, str]) -> DataFrame:
    """Keep the rows whose value is a key of ``labels`` and write the label in its place.

    No labels keep every row. Values are compared by their text.
    """
    if not labels:
        return df
    text = text_of(df, column)
    kept = df.where(text.isin(list(labels)))
    if all(old == new for old, new in labels.items()):
        return kept
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return kept.withColumn(column, lookup[text])


def filter_text(df: DataFrame, column: str, step: str) -> DataFrame:
    """``filter:VALUE`` step: the text of the cell equals what follows the last colon."""
    return df.where(text_of(df, column) == F.lit(step.rsplit(":", 1)[-1]))


def select_leaves(df: DataFrame, leaf: str, target: Sequence[str]) -> DataFrame:
    """Leaves chosen level by level: ``all``, ``latest`` or the id at that depth.

    The leaf id joins its levels by ``-``; ``latest`` keeps the one leaf with the
    greatest last part, the greater id on a tie.
    """
    kept = df
    for depth, component in enumerate(target):
        if component == "all":
            continue
        if component == "latest":
            last = F.substring_index(col(leaf), "-", -1)
            kept = kept.orderBy(last.desc_nulls_last(), col(leaf).desc_nulls_last()).limit(1)
        else:
            kept = kept.where(F.get(F.split(col(leaf), "-"), F.lit(depth)) == component)
    return kept
