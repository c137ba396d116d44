"""Named data fields of a report: files, inline data and references, resolved to lazy DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col
from gaugeframe.functions.scalars import capitalise_words, strip_newlines
from gaugeframe.operators import runs
from gaugeframe.plans.table_options import TableOptions, apply_options
from gaugeframe.session import scratch_dir
from gaugeframe.sources import readers

Preprocessor = Callable[[DataFrame], DataFrame]
PREPROCESSORS: dict[str, Preprocessor] = {}


def preprocessor(name: str) -> Callable[[Preprocessor], Preprocessor]:
    """Register a table function under the name a field asks for."""

    def register(function: Preprocessor) -> Preprocessor:
        PREPROCESSORS[name] = function
        return function

    return register


preprocessor("uppercase_names")(lambda df: df.withColumn("name", F.upper("name")) if "name" in df.columns else df)
preprocessor("strip_newlines")(lambda df: df.withColumn("value", strip_newlines(F.col("value"))))
preprocessor("capwords")(lambda df: df.withColumn("value", capitalise_words(F.col("value"))))


@preprocessor("run_facts")
def _run_facts(df: DataFrame) -> DataFrame:
    """Facts of typed reports, or of report documents in a ``value`` column, with every field of their runs and cases."""
    if df.columns == ["value"]:
        texts = df.select(col("value").cast("string").alias("value"))
        df = runs.parse_reports(texts, "value", runs.report_schema(*runs.discover_fields(texts, "value")))
    return runs.run_facts(df)


@dataclass(frozen=True)
class Field:
    """``source`` is one of ``path``, ``columns``, ``object``, ``value``, ``ref`` and ``table`` (a DataFrame)."""

    name: str
    source: str
    given: Any
    kind: str | None = None
    format: str | None = None
    schema: Any = None
    preprocessor: str | Preprocessor | None = None
    options: TableOptions | None = None
    order_by: str | None = None

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Field:
        known = {"name", "type", "filepath", "format", "columns", "object", "value", "ref", "preprocessor",
                 "table_options", "expose", "schema", "order_by"}
        if set(config) - known:
            raise ValueError(f"unknown field keys: {sorted(set(config) - known)}")
        sources = {"filepath": "path", "columns": "columns", "object": "object", "value": "value", "ref": "ref"}
        given = [k for k in sources if k in config]
        if len(given) != 1:
            raise ValueError(f"field {config.get('name')} needs one source, it has {given}")
        source = sources[given[0]]
        kind = config.get("type")
        if kind is None and source != "ref":
            by_format = {"json": "Object", "csv": "DataTable", "raw": "Raw"}
            by_source = {"columns": "DataTable", "object": "Object", "value": "Raw"}
            file_format = config.get("format") or (readers.format_of(config["filepath"]) if source == "path" else None)
            kind = by_format[file_format] if source == "path" else by_source[source]
        options = TableOptions.from_config(config["table_options"]) if config.get("table_options") else None
        return cls(
            config["name"], source, config[given[0]], kind, config.get("format"), config.get("schema"),
            config.get("preprocessor"), options, config.get("order_by"),
        )


def _adds_nothing(field: Field) -> bool:
    """A reference without a preprocessor: before its options it is the field it refers to."""
    return field.source == "ref" and field.preprocessor is None


def _passes_on(field: Field) -> bool:
    """A plain reference is the other field itself, or a sorted view of it that each reader works out."""
    sorts = field.options is not None and bool(field.options.sort)
    return _adds_nothing(field) and (sorts or (field.options is None and field.kind is None))


def count_readings(fields: Mapping[str, Field], sinks: Iterable[str]) -> Counter[str]:
    """How often each field is worked out if nothing is stored but what is read several times.

    References are followed backwards from the sinks: a stored field reads its source once, however
    many read it, and one that passes its source on reads it each time.
    """
    wanted = Counter(sinks)
    users: dict[str, list[Field]] = {}
    for field in fields.values():
        if field.source == "ref":
            users.setdefault(field.given, []).append(field)
    counted: Counter[str] = Counter()

    def count(name: str, waiting: tuple[str, ...]) -> int:
        if name in waiting:
            return 0  # a circle; resolving it fails
        if name not in counted:
            counted[name] = wanted[name]
            for user in users.get(name, []):
                readings = count(user.name, (*waiting, name))
                counted[name] += readings if _passes_on(user) else min(readings, 1)
        return counted[name]

    for name in fields:
        count(name, ())
    return counted


class Fields:
    """Resolves fields by name; every field is planned once and shared by its references.

    ``sinks`` names the fields that the outputs of a request read, one name for each reading. A field that is read
    several times, by outputs or by other fields that are needed, is worked out once and stored in the shared folder when it is
    resolved; the others stay lazy. A sorted table is stored before its options, as stored rows have no order.
    """

    def __init__(self, spark: SparkSession, fields: Iterable[Field], sinks: Iterable[str] = ()):
        self.spark = spark
        self.fields = {f.name: f for f in fields}
        self.planned: dict[str, DataFrame] = {}
        self.readings = count_readings(self.fields, sinks)

    def kind(self, name: str) -> str:
        field = self.fields[name]
        return field.kind or (self.kind(field.given) if field.source == "ref" else "DataTable")

    def resolve(self, name: str, waiting: tuple[str, ...] = ()) -> DataFrame:
        if name in waiting:
            raise ValueError(f"fields refer to each other in a circle: {' -> '.join([*waiting, name])}")
        if name not in self.fields:
            raise KeyError(f"reference {name} not found")
        if name not in self.planned:
            field = self.fields[name]
            df = self._load(field, (*waiting, name))
            if field.preprocessor:
                step = field.preprocessor
                df = df.transform(PREPROCESSORS[step] if isinstance(step, str) else step)
            keep = self.readings[name] > 1 and field.source not in ("columns", "object", "value")
            is_sorted = bool(field.options and field.options.sort)
            if keep and is_sorted and not _adds_nothing(field):
                df = self._stored(df, name)
            df = self._process(field, df)
            self.planned[name] = self._stored(df, name) if keep and not is_sorted and not _passes_on(field) else df
        return self.planned[name]

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as a file; what a file can't hold (no columns, a column without a type) stays lazy."""
        if not df.columns or any(f.dataType.typeName() == "void" for f in df.schema):
            return df
        path = scratch_dir(self.spark, f"field-{len(self.planned)}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _load(self, field: Field, waiting: tuple[str, ...]) -> DataFrame:
        if field.source == "ref":
            return self.resolve(field.given, waiting)
        if field.source == "path":
            shape = field.format or readers.format_of(field.given)
            if shape == "json" and field.kind == "Object" and not field.schema:
                return readers.read_raw(self.spark, field.given).select(readers.text_to_object(col("value")).alias("value"))
            return readers.read_file(self.spark, field.given, shape, field.schema)
        if field.source == "columns":
            return readers.inline_table(self.spark, field.given)
        if field.source == "object":
            return readers.inline_object(self.spark, field.given)
        if field.source == "value":
            return readers.inline_raw(self.spark, field.given)
        return field.given

    def _process(self, field: Field, df: DataFrame) -> DataFrame:
        kind = self.kind(field.name)
        plain = df.columns == ["value"]
        if kind == "DataTable":
            if plain and field.source != "columns" and df.schema["value"].dataType.typeName() in ("string", "variant"):
                raise ValueError(f"cannot make a table of {field.name}: give a schema or a preprocessor")
            return apply_options(df, field.options, field.order_by) if field.options else df
        if kind == "Object" and plain and df.schema["value"].dataType.typeName() == "string":
            return df.select(readers.text_to_object(col("value")).alias("value"))
        if kind == "Object" and field.order_by:
            return readers.table_to_object(df, field.order_by)
        if kind == "Raw" and plain and df.schema["value"].dataType.typeName() == "variant":
            return df.select(readers.object_to_text(col("value")).alias("value"))
        if kind == "Raw" and not plain:
            return readers.table_to_text(df)
        return df
