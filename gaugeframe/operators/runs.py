"""Run reports: nested documents to fact rows, and the summaries kept of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.columns import col, cols, explode_rows, require_columns, variant_text
from gaugeframe.operators.aggregates import sorted_positions
from gaugeframe.operators.metrics import number_or_text

# The fields of a run report, and the slots of a metric array.
SESSION_FIELDS = {
    "hostname": "STRING", "user": "STRING", "time_start": "STRING", "time_end": "STRING",
    "num_cases": "BIGINT", "num_failures": "BIGINT",
}
RUN_FIELDS = {"run_index": "BIGINT", "num_cases": "BIGINT", "num_failures": "BIGINT"}
CASE_FIELDS = {
    "hashcode": "STRING", "system": "STRING", "partition": "STRING", "result": "STRING", "time_total": "DOUBLE",
}
METRIC_SLOTS = ["value", "reference", "low_threshold", "up_threshold", "unit", "result"]


def report_schema(run_fields: Mapping[str, str] = RUN_FIELDS, case_fields: Mapping[str, str] = CASE_FIELDS) -> T.StructType:
    """Schema of a report; pass more fields to carry them into the facts."""
    fields = lambda spec: ", ".join(f"`{n}`: {t}" for n, t in spec.items())
    case = f"STRUCT<{fields(case_fields)}, check_params: MAP<STRING, VARIANT>, perfvalues: MAP<STRING, ARRAY<STRING>>>"
    run = f"STRUCT<{fields(run_fields)}, testcases: ARRAY<{case}>>"
    return T.StructType.fromDDL(f"session_info STRUCT<{fields(SESSION_FIELDS)}>, runs ARRAY<{run}>")


def parse_reports(df: DataFrame, text: str, schema: T.StructType | None = None) -> DataFrame:
    """Replace the JSON text of a report by its fields; broken text fails the query."""
    parsed = F.from_json(col(text), schema or report_schema(), {"mode": "FAILFAST"}).alias("__report")
    rest = cols(c for c in df.columns if c != text)
    return df.select(*rest, parsed).select(*rest, "__report.*")


def discover_fields(df: DataFrame, text: str) -> tuple[dict[str, str], dict[str, str]]:
    """Fields of the runs and of the cases in JSON reports: the known ones, and any other as text.

    One pass collects the names, as many as the report format has.
    """
    runs = F.from_json(col(text), "runs ARRAY<MAP<STRING, STRING>>")["runs"]
    run = explode_rows(df, [], runs, "__run").select(F.col("__run"))
    cases = F.from_json(F.col("__run")["testcases"], "ARRAY<MAP<STRING, STRING>>")
    names = lambda rows, c: {r[0] for r in rows.select(F.explode(F.map_keys(c))).distinct().collect()}
    run_names = names(run, F.col("__run")) - {"testcases", *RUN_FIELDS}
    case_names = names(explode_rows(run, [], cases, "__case"), F.col("__case")) - {"check_params", "perfvalues", *CASE_FIELDS}
    return RUN_FIELDS | dict.fromkeys(sorted(run_names), "STRING"), CASE_FIELDS | dict.fromkeys(sorted(case_names), "STRING")


def _parameters(check_params: Column) -> Column:
    """Parameters as Python shows them; an object gives one ``dim.sub`` entry per field.

    The JSON kind decides: a text that looks like an object, a flag or a number stays that text.
    """
    entry_of = lambda key, value: F.struct(key.alias("key"), _parameter_text(value).alias("value"))

    def entries(entry):
        fields = F.map_entries(F.try_variant_get(entry["value"], "$", "map<string,variant>"))
        nested = F.transform(fields, lambda f: entry_of(F.concat(entry["key"], F.lit("."), f["key"]), f["value"]))
        is_object = F.schema_of_variant(entry["value"]).startswith("OBJECT<")
        return F.when(is_object, nested).otherwise(F.array(entry_of(entry["key"], entry["value"])))

    return F.map_from_entries(F.flatten(F.transform(F.map_entries(check_params), entries)))


def _parameter_text(value: Column) -> Column:
    """Text of a scalar; a list or a deeper object as JSON."""
    kind = F.schema_of_variant(value)
    nested = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
    return F.when(nested, F.to_json(value)).otherwise(variant_text(value))


def split_metric_key(key: Column) -> list[Column]:
    """System, partition and name of ``system:partition:name``; a missing part is null."""
    parts = F.split(key, ":")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(["system", "partition", "perfvalue"])]


def metric_slots(values: Column) -> list[Column]:
    """Columns of a metric array; a value that is no number is kept in ``value_str``."""
    slot = {n: F.get(values, F.lit(i)) for i, n in enumerate(METRIC_SLOTS)}
    number, text = number_or_text(slot["value"])
    return [
        number.alias("value"),
        text.alias("value_str"),
        *[number_or_text(slot[n])[0].alias(n) for n in ("reference", "low_threshold", "up_threshold")],
        slot["unit"].alias("unit"),
        slot["result"].alias("result"),
    ]


def run_facts(reports: DataFrame, runs: str = "runs") -> DataFrame:
    """One row per run, test case and metric, with ``runs.*``, ``testcases.*`` and the ``params`` map.

    A case without metrics gives one row of nulls with its own system, partition
    and result. Only generators: the rows never leave their partition.
    """
    case_type = reports.schema[runs].dataType.elementType["testcases"].dataType.elementType
    run_names = [n for n in reports.schema[runs].dataType.elementType.names if n != "testcases"]
    case_names = [n for n in case_type.names if n not in ("check_params", "perfvalues")]
    keys = [c for c in reports.columns if c not in (runs, "session_info")]

    in_run = explode_rows(reports, cols(keys), col(runs), "__run").select(
        *cols(keys), *[F.col("__run")[n].alias(f"runs.{n}") for n in run_names], F.col("__run.testcases").alias("__cases")
    )
    carried = cols([*keys, *[f"runs.{n}" for n in run_names]])
    in_case = explode_rows(in_run, carried, F.col("__cases"), "__case").select(
        *carried,
        *[F.col("__case")[n].alias(f"testcases.{n}") for n in case_names],
        _parameters(F.col("__case.check_params")).alias("params"),
        F.col("__case.perfvalues").alias("perfvalues"),
    )
    carried += [*cols([f"testcases.{n}" for n in case_names]), F.col("params")]
    rows = in_case.select(*carried, F.explode_outer("perfvalues").alias("__key", "__values"))
    system, partition, name = split_metric_key(F.col("__key"))
    bare = F.col("__key").isNull()
    values = metric_slots(F.col("__values"))
    own = lambda n, otherwise: F.when(bare, col(f"testcases.{n}")).otherwise(otherwise).alias(n)
    return rows.select(
        *cols(keys),
        name,
        *values[:-1],
        own("result", values[-1]),
        own("system", system),
        own("partition", partition),
        *cols([f"testcases.{n}" for n in case_names]),
        "params",
        *cols([f"runs.{n}" for n in run_names]),
    )


def empty_facts(spark: SparkSession) -> DataFrame:
    """Facts of an empty report: the columns and no rows."""
    return run_facts(spark.createDataFrame([], report_schema()))


def parameter_columns(facts: DataFrame, names: Sequence[str], params: str = "params") -> DataFrame:
    """Project parameters out of the map as columns of their own."""
    return facts.withColumns({n: col(params)[n] for n in names})


def leaf_summary(facts: DataFrame, leaf: str = "leaves", levels: Sequence[str] = ()) -> DataFrame:
    """One row per leaf: runs, date, cases, failures and the overall result.

    Counts are those of the first run. The result is pass only if every row passed.
    """
    run = col("runs.run_index")
    first = lambda name: F.min_by(col(name), F.when(col(name).isNotNull(), run)).alias(name)
    passed = F.bool_and(col("result").eqNullSafe("pass"))
    return (
        facts.where(col(leaf).isNotNull())
        .groupBy(col(leaf))
        .agg(
            (F.max(run) + 1).alias("num_runs"),
            F.min("date").alias("date"),
            first("runs.num_cases").alias("num_cases"),
            first("runs.num_failures").alias("num_failures"),
            F.when(passed, "pass").otherwise("fail").alias("result"),
            *[F.min(col(level)).alias(level) for level in levels],
        )
    )


def summary_columns(leaf: str = "leaves") -> dict[str, Column]:
    """Aggregates that sum up leaves; the result is that of the latest leaf, the greater id on a tie."""
    at = F.struct(col("date"), col(leaf))
    return {
        "num_runs": F.sum("num_runs"),
        "num_cases": F.sum("num_cases"),
        "num_failures": F.sum("num_failures"),
        "result": F.max_by(col("result"), at),
        "latest": F.max("date"),
        "latest_leaf": F.max_by(col(leaf), at),
    }


def group_summary(leaves: DataFrame, level: str, leaf: str = "leaves") -> DataFrame:
    """Summary per value of a level, from the leaf summary."""
    require_columns(leaves, [level, leaf])
    known = leaves.where(col(level).isNotNull())
    return known.groupBy(col(level)).agg(*[a.alias(n) for n, a in summary_columns(leaf).items()])


def latest_first(leaves: DataFrame, leaf: str = "leaves") -> DataFrame:
    """The leaf summary, latest leaf first, the greater id on a tie, with its ``place`` from 0."""
    return sorted_positions(leaves, [("date", False), (leaf, False)], "place")


def latest_reports(facts: DataFrame, n: int = 15, leaf: str = "leaves", levels: Sequence[str] = ()) -> DataFrame:
    """The latest reports with their status, for the overview page.

    Level columns the facts lack are left out. Only the top rows are sorted.
    """
    present = [c for c in levels if c in facts.columns]
    per_leaf = facts.where(col(leaf).isNotNull()).groupBy(col(leaf)).agg(
        F.min("date").alias("date"),
        F.max(col("runs.num_failures")).alias("num_failures"),
        *[F.min(col(c)).alias(c) for c in present],
    )
    top = per_leaf.orderBy(F.col("date").desc_nulls_last(), col(leaf).desc_nulls_last()).limit(n)
    return top.withColumn("status", status_icon(F.col("num_failures") == 0))


def status_icon(passed: Column) -> Column:
    return F.when(passed, F.lit("🟢")).otherwise(F.lit("🔴"))
