"""Files, inline data and documents as DataFrames."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.columns import col, cols, explode_rows, text_of
from gaugeframe.operators.ordinals import group_ordinals

# File suffix to format, and the Python type names an inline column may ask for.
SUFFIXES = {"json": "json", "csv": "csv", "txt": "raw"}
INLINE_TYPES = {"int": (int, "bigint"), "float": (float, "double"), "str": (str, "string"), "bool": (bool, "boolean")}

# A string literal is matched first, so that comment signs inside it stay.
_COMMENTS = r'(?ms)("[^"\\]*(?:\\.[^"\\]*)*")|(?://.*?$|/\*.*?\*/)\s*'
_TRAILING_COMMA = r",(?=\s*[\]}])"


def format_of(path: str) -> str:
    """Format by suffix; an unknown suffix is read as raw text with a warning."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in SUFFIXES:
        warnings.warn(f"unknown suffix {suffix!r} of {path}: read as raw text", stacklevel=2)
    return SUFFIXES.get(suffix, "raw")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which scans the files once more."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """One document or one list of documents per file, or one per line. Broken documents fail the read."""
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole text of each file."""
    return spark.read.text(path, wholetext=True)


def read_file(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    kind = kind or format_of(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema)
    if kind == "raw":
        return read_raw(spark, path)
    raise ValueError(f"unknown format {kind} for {path}")


def inline_table(spark: SparkSession, columns: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Table from ``{name, values, dtype}`` columns of equal length."""
    if len({len(c["values"]) for c in columns}) > 1:
        raise ValueError("inline table columns should have the same length")
    data, fields = [], []
    for c in columns:
        values, dtype = list(c["values"]), c.get("dtype")
        if dtype is not None:
            if dtype not in INLINE_TYPES:
                raise ValueError(f"unsupported type name {dtype!r}")
            cast, _ = INLINE_TYPES[dtype]
            values = [cast(v) for v in values]
        kinds = {type(v) for v in values if v is not None}
        if kinds == {int, float}:
            values, kinds = [None if v is None else float(v) for v in values], {float}
        if len(kinds) > 1:
            values, kinds = [None if v is None else str(v) for v in values], {str}
        name = next((k.__name__ for k in kinds), "str")
        fields.append(T.StructField(c["name"], T.StructType.fromDDL(f"x {INLINE_TYPES[name][1]}")["x"].dataType))
        data.append(values)
    return spark.createDataFrame(list(zip(*data)), T.StructType(fields))


def inline_object(spark: SparkSession, document: Mapping[str, Any]) -> DataFrame:
    """One row with the document as a variant."""
    return inline_raw(spark, json.dumps(document)).select(F.parse_json("value").alias("value"))


def inline_raw(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")


def relaxed_json(text: Column) -> Column:
    """JSON text without comments and trailing commas.

    Comment signs inside strings stay; a comma before a closing bracket goes even
    inside a string.
    """
    return F.regexp_replace(F.regexp_replace(text, _COMMENTS, "$1"), _TRAILING_COMMA, "")


def records_to_table(df: DataFrame, document: str, schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """A JSON list of records to one row per record; ``schema`` is that of a record."""
    record = F.from_json(col(document), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return explode_rows(df, cols(keys), record, "__row").select(*cols(keys), "__row.*")


def object_to_table(df: DataFrame, document: str, schema: str, keys: Sequence[str] = (), name: str = "index") -> DataFrame:
    """A JSON object of records to one row per key."""
    entries = F.from_json(col(document), f"map<string,struct<{schema}>>", {"mode": "FAILFAST"})
    rows = explode_rows(df, cols(keys), F.map_entries(entries), "__entry")
    return rows.select(*cols(keys), F.col("__entry.key").alias(name), "__entry.value.*")


def table_to_object(df: DataFrame, order_by: str) -> DataFrame:
    """The lists ``{column: [values]}`` of a table as ``(column, position, value)`` rows.

    One shape at every size: a list is its rows in the order of the position, and no
    task holds a whole one. Values are JSON texts; a null keeps its place.
    """
    names = [c for c in df.columns if c != order_by]
    placed = group_ordinals(df, [], order_by, "__at")
    as_json = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(col(c).alias("v")), {"ignoreNullFields": "false"}), "$"), F.lit("{}"))
    value = lambda c: F.regexp_extract(as_json(c), r'(?s)^\{"v":(.*)\}$', 1)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in names])
    return placed.select(F.col("__at").alias("position"), F.explode(cells).alias("c")).select("c.column", "position", "c.value")


def object_to_text(value: Column) -> Column:
    return F.to_json(value)


def text_to_object(text: Column) -> Column:
    return F.parse_json(text)


def table_to_text(df: DataFrame, separator: str = " ") -> DataFrame:
    """Rows as one text each."""
    return df.select(F.concat_ws(separator, *[F.coalesce(text_of(df, c), F.lit("nan")) for c in df.columns]).alias("value"))


def report_tree(
    spark: SparkSession,
    base: str,
    levels: Sequence[str],
    file_name: str,
    schema: T.StructType | str,
    multi_line: bool = True,
) -> DataFrame:
    """Reports under ``base/<level>/…/<date>/<file>`` with a column per level, ``date`` and ``leaf``.

    A folder may be a bare name or ``key=name``. The leaf id joins the levels and
    the date folder by ``-``. One scan lists and reads the whole tree.
    """
    folders = "/".join(["*"] * (len(levels) + 1))
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
    reports = reader.json(f"{base.rstrip('/')}/{folders}/{file_name}")
    return place_in_tree(reports.select("*", F.col("_metadata.file_path").alias("__file")), "__file", levels)


def place_in_tree(df: DataFrame, file: str, levels: Sequence[str]) -> DataFrame:
    """Level columns, ``date`` and ``leaf`` from the folders of a file path."""
    pattern = "/".join([r"(?:[^/=]+=)?([^/]+)"] * (len(levels) + 1)) + r"/[^/]+$"
    part = lambda i: F.url_decode(F.regexp_extract(col(file), pattern, i))
    placed = df.withColumns({level: part(i + 1) for i, level in enumerate(levels)})
    folder = part(len(levels) + 1)
    return placed.withColumns(
        {
            "date": F.try_to_timestamp(folder, F.lit("yyyy_MM_dd'T'HH_mm_ss")),
            "leaf": F.concat_ws("-", *[col(level) for level in levels], folder),
        }
    ).drop(file)
