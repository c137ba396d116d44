"""Parameter grids: generators as array columns, expanded row by row and pruned.

A generator gives an array per base row and the grid is a chain of ``explode``:
no join, no shuffle, and it scales with the base rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, explode_rows, python_text


def _number(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _steps(n: Column) -> Column:
    """``[0 … n-1]``, empty for n < 1."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def linspace(low: Any, high: Any, n: Any) -> Column:
    """``n`` even steps with both ends; a single step is the low end."""
    low, high, n = _number(low).cast("double"), _number(high).cast("double"), _number(n)
    gap = F.try_divide(high - low, (n - 1).cast("double"))
    return F.transform(
        _steps(n), lambda i: F.when(i == 0, low).when(i == n - 1, high).otherwise(low + i * gap)
    )


def geomspace(low: Any, high: Any, n: Any) -> Column:
    """``n`` steps of equal ratio; both ends are exact."""
    low, high, n = _number(low).cast("double"), _number(high).cast("double"), _number(n)
    ratio = high / low
    power = lambda i: F.pow(ratio, F.try_divide(i.cast("double"), (n - 1).cast("double")))
    return F.transform(
        _steps(n), lambda i: F.when(i == 0, low).when(i == n - 1, high).otherwise(low * power(i))
    )


def geometric(start: Any, ratio: Any, n: Any) -> Column:
    start, ratio = _number(start).cast("double"), _number(ratio).cast("double")
    return F.transform(_steps(_number(n)), lambda i: start * F.pow(ratio, i))


def value_range(low: Any, high: Any, step: Any) -> Column:
    """``low, low+step, …`` until just under ``high + step``.

    When the step does not divide the interval the last value passes ``high``.
    """
    low, high, step = (_number(v).cast("double") for v in (low, high, step))
    count = F.ceil((high + step - low) / step)
    return F.transform(_steps(count), lambda i: low + i * step)


def values(items: Sequence[Any]) -> Column:
    """The listed values; dicts become structs with the fields of the first one."""
    if items and isinstance(items[0], Mapping):
        return F.array(*[F.struct(*[F.lit(item[k]).alias(k) for k in items[0]]) for item in items])
    return F.array(*[F.lit(v) for v in items])


def repeat(value: Any, count: int) -> Column:
    return F.array_repeat(_number(value), _number(count))


def zipped(generators: Mapping[str, Column]) -> Column:
    """Structs of the i-th values; stops at the shortest generator."""
    sizes = [F.size(g) for g in generators.values()]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    pick = lambda i: F.struct(*[F.get(g, i).alias(n) for n, g in generators.items()])
    return F.transform(_steps(shortest), pick)


@dataclass(frozen=True)
class Parameter:
    """A named generator. ``conditions`` maps a value (as text) to alternatives ``{name: allowed values}``."""

    name: str
    generator: Column
    active: bool = True
    conditions: Mapping[str, Sequence[Mapping[str, Sequence[Any]]]] | None = None


def expand(base: DataFrame, parameters: Sequence[Parameter]) -> DataFrame:
    """Every combination of the active parameters for every base row."""
    for p in parameters:
        if p.active:
            base = explode_rows(base, cols(base.columns), p.generator, p.name).drop("__position")
    return base


def _path(name: str) -> Column:
    head, *rest = name.split(".")
    return reduce(lambda c, field: c[field], rest, col(head))


def _conditions(parameters: Sequence[Parameter]) -> list[tuple[str, str, Sequence[Mapping[str, Sequence[Any]]]]]:
    """(parameter, value, alternatives) of every condition that can drop a combination."""
    return [(p.name, v, alts) for p in parameters if p.active and p.conditions for v, alts in p.conditions.items() if alts]


def _needs(condition: tuple) -> set[str]:
    """The columns a condition reads."""
    name, _, alternatives = condition
    return {name} | {n.split(".")[0] for alternative in alternatives for n in alternative}


def _held(grid: DataFrame, condition: tuple) -> Column:
    """False for combinations that break a condition: no alternative allows all its names."""
    name, value, alternatives = condition
    text = python_text(col(name), grid.schema[name].dataType)
    allowed = [
        reduce(lambda a, b: a & b, [F.coalesce(_path(n).isin(list(v)), F.lit(False)) for n, v in alt.items()], F.lit(True))
        for alt in alternatives
    ]
    return F.coalesce((text != value) | reduce(lambda a, b: a | b, allowed), F.lit(True))


def prune(grid: DataFrame, parameters: Sequence[Parameter]) -> DataFrame:
    """Drop combinations that break the conditions of a parameter value.

    One alternative must allow all its names. A value without an entry is free.
    """
    for condition in _conditions(parameters):
        grid = grid.where(_held(grid, condition))
    return grid


def _alone(base: DataFrame, generator: Column) -> bool:
    """Whether a generator reads columns of the base only."""
    try:
        return bool(base.select(generator).schema)
    except AnalysisException:
        return False


def growing_order(base: DataFrame, parameters: Sequence[Parameter]) -> list[Parameter]:
    """The active parameters so that conditions can be tested early: next comes the one that completes most conditions, else
    the one a condition waits for with the fewest others. A generator that reads other parameters stays behind those before it."""
    left = [p for p in parameters if p.active]
    waiting = [_needs(c) for c in _conditions(parameters)]
    known, done = set(base.columns), []
    while left:
        free = [p for i, p in enumerate(left) if i == 0 or _alone(base, p.generator)]

        def gain(p: Parameter) -> tuple[int, int]:
            open_ = [needs - known for needs in waiting if p.name in needs - known]
            return sum(len(o) == 1 for o in open_), -min(map(len, open_), default=len(left) + 1)

        best = max(free, key=gain)
        left.remove(best)
        known.add(best.name)
        done.append(best)
    return done


def parameter_grid(base: DataFrame, parameters: Sequence[Parameter]) -> DataFrame:
    """Every combination of the active parameters that keeps the conditions, for every base row.

    A condition is tested as soon as the grid has all its names, between two generators, so what
    it drops is never combined with the parameters that come later.
    """
    conditions, grid = _conditions(parameters), base
    for p in growing_order(base, parameters):
        grid = expand(grid, [p])
        ready = [c for c in conditions if _needs(c) <= set(grid.columns)]
        conditions = [c for c in conditions if c not in ready]
        for condition in ready:
            grid = grid.where(_held(grid, condition))
    if conditions:
        missing = sorted(set().union(*map(_needs, conditions)) - set(grid.columns))
        raise ValueError(f"conditions on parameters that are not there: {missing}")
    return grid.select(*cols(base.columns), *cols(p.name for p in parameters if p.active))


def flatten_parameters(grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Struct parameters as ``outer.inner`` columns."""
    for name in names:
        fields = grid.schema[name].dataType.names
        grid = grid.withColumns({f"{name}.{f}": col(name)[f] for f in fields}).drop(name)
    return grid
