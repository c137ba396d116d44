"""Column helpers: safe names, Python string forms, status values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by its whole name; dots and blanks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; the table has {df.columns}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def rare(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` evaluated outside the generated code.

    A long expression for a rare case would make the generated method too big for
    the JVM to compile, and the common case slow with it.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def number_text(value: Column) -> Column:
    """A double as Python writes it: 1.0, 10000000.0, 1e+16, 1e-05, nan, inf.

    Both sides print the shortest digits that read back to the same number; only
    the layout differs, and only outside of 0.001 to 10^7.
    """
    value = value.cast("double")
    size = F.abs(value)
    alike = ((size >= 1e-3) & (size < 1e7)) | (size == 0)
    return F.when(alike | value.isNull(), value.cast("string")).otherwise(rare(value, _long_number))


def _long_number(value: Column) -> Column:
    """Between 1e-4 and 1e16 Python uses no exponent, elsewhere one of two digits or more."""
    text = value.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    size = F.abs(value)
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def python_text(column: Column, dtype: T.DataType) -> Column:
    """The text Python's ``str`` gives: ``True``, ``1.0``; null stays null."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(column)
    return column.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return python_text(col(name), data_type(df, name))


def variant_text(value: Column) -> Column:
    """Text of a variant scalar as Python writes it; a JSON null is null.

    Variants store 18.0 as the decimal 18, so a number with a point goes by its double.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), number_text(F.try_variant_get(value, "$", "double")))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def choose_column(choices: str | None, available: Sequence[str]) -> str | None:
    """First name of ``a|b|c`` the table has; None when there is none."""
    if not choices:
        return None
    return next((name for name in choices.split("|") if name in available), None)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right side's key columns are dropped.

    ``<=>`` is planned as an ordinary hash or sort-merge join, so a hot key on
    the left is split by the adaptive skew-join rule.
    """
    renamed = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for i, k in enumerate(keys):
        match = col(k).eqNullSafe(col(renamed[k]))
        condition = match if i == 0 else condition & match
    joined = left.join(right, condition, how)
    return joined.drop(*renamed.values())


def explode_rows(
    df: DataFrame, keep: Sequence[Column], array: Column, item: str, position: str = "__position"
) -> DataFrame:
    """A row per array item with its position, like ``posexplode``, computing the array once.

    Under a plain explode Spark adds a filter on the size of the array, which
    would work out a parsed document or a list of matches three times.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.where(col(position).isNotNull())
