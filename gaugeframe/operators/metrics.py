"""Metrics from csv, tsv, json and log files as ``(name, value, value_str, unit)`` rows.

Extractors of file texts, one per row, work inside the text's own partition; only merging
stages shuffles. Csv and tsv files of any size are read line by line, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, explode_rows, variant_text
from gaugeframe.functions.nested import FOUND, entry, fields_of, nesting_bound, unfold
from gaugeframe.session import scratch_dir

DEFAULT_UNITS = {"*": "s"}
# A csv cell that is a number, and a text Python reads as a float.
CSV_NUMBER = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
FLOAT = r"(?i)^\s*[-+]?(\d+\.?\d*(e[-+]?\d+)?|\.\d+(e[-+]?\d+)?|inf|infinity|nan)\s*$"


def metric_units(name: Column, units: Mapping[str, str] = DEFAULT_UNITS) -> Column:
    """Unit of a metric, else that of ``*``."""
    default = F.lit(units.get("*"))
    named = [F.lit(x) for pair in units.items() for x in pair if pair[0] != "*"]
    return F.coalesce(F.create_map(*named)[name], default) if named else default


def number_or_text(text: Column, pattern: str = FLOAT) -> tuple[Column, Column]:
    """The number a text holds, and the text where it holds none.

    The pattern comes first because a cast alone also reads ``10d`` as a number.
    """
    number = F.when(text.rlike(pattern), text.try_cast("double"))
    return number, F.when(number.isNull(), text)


def _finish(
    rows: DataFrame, keys: Sequence[str], name: Column, text: Column, stage: str | None, suffix: Column | None,
    units: Mapping[str, str], pattern: str = FLOAT,
) -> DataFrame:
    full = F.concat(F.lit(f"{stage}_"), name) if stage else name
    number, rest = number_or_text(text, pattern)
    return rows.select(
        *cols(keys),
        (full if suffix is None else F.concat(full, suffix)).alias("name"),
        number.alias("value"),
        rest.alias("value_str"),
        metric_units(name, units).alias("unit"),
    )


def _last_of_name(cells: DataFrame) -> DataFrame:
    """Of columns with the same header the last counts."""
    later = F.slice("__header", F.col("__i") + 2, F.size("__header"))
    return cells.where(~F.coalesce(F.array_contains(later, F.get("__header", F.col("__i"))), F.lit(False)))


def csv_metrics(
    files: DataFrame, text: str, keys: Sequence[str], stage: str | None = None, units: Mapping[str, str] = DEFAULT_UNITS
) -> DataFrame:
    """Header and rows; with more than one row the names end in ``_<row>``.

    Blank lines and blank cells are skipped; a row of another width than the
    header is an error.
    """
    lines = F.filter(F.split(col(text), r"\r?\n"), lambda line: F.trim(line) != "")
    table = F.transform(lines, _csv_cells)
    parsed = files.select(*cols(keys), table.alias("__t")).select(
        *cols(keys),
        F.get("__t", F.lit(0)).alias("__header"),
        F.slice("__t", F.lit(2), F.greatest(F.size("__t") - 1, F.lit(0))).alias("__rows"),
    )
    kept = [*cols(keys), F.col("__header"), F.size("__rows").alias("__n")]
    in_rows = explode_rows(parsed, kept, F.col("__rows"), "__cells", "__row")
    return _csv_rows(in_rows, keys, stage, units)


def _csv_cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), lambda c: F.trim(c)), lambda c: c != "")


def _csv_rows(in_rows: DataFrame, keys: Sequence[str], stage: str | None, units: Mapping[str, str]) -> DataFrame:
    """Metrics of rows with ``__header`` and number of rows ``__n`` of their file, place ``__row`` and ``__cells``."""
    width = F.size("__cells") == F.size("__header")
    cells = F.when(width, F.col("__cells")).otherwise(F.raise_error(F.lit("csv row and header differ in width")))
    in_cells = explode_rows(in_rows, cols([*keys, "__header", "__n", "__row"]), cells, "__cell", "__i")
    in_cells = _last_of_name(in_cells)
    name = F.get("__header", F.col("__i"))
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__row").cast("string"))).otherwise(F.lit(""))
    return _finish(in_cells, keys, name, F.col("__cell"), stage, suffix, units, CSV_NUMBER)


def _placed_lines(spark: SparkSession, paths: str | Sequence[str], blank: bool) -> tuple[DataFrame, DataFrame]:
    """Lines of files of any size as ``(file, __line, __at)``, and ``(file, __first, __lines)`` of every file.

    A file is read in blocks by several tasks. A block numbers its own lines, and the numbers of lines of the
    blocks before, a row each, give the place in the file; so no file passes through one task. The numbered
    lines are stored, as blocks are cut anew whenever files are read again. Lines are blank only if asked for.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block")]
    lines = spark.read.text(paths).select(*place, F.col("value").alias("__line"))
    # A file's first line may start with a byte order mark.
    lines = lines.withColumn("__line", F.when(F.col("__block") == 0, F.regexp_replace("__line", "^\ufeff", "")).otherwise(F.col("__line")))
    if not blank:
        lines = lines.where(F.trim("__line") != "")
    numbered = lines.withColumn("__id", F.monotonically_increasing_id())
    path = scratch_dir(spark, "metric-lines")
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    blocks = rows.groupBy("file", "__block").agg(
        F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__low"), F.min_by("__line", "__id").alias("__top")
    )
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__low")
    starts = blocks.select("file", "__block", start.alias("__shift"))
    placed = rows.join(starts, ["file", "__block"]).select("file", "__line", (F.col("__id") + F.col("__shift")).alias("__at"))
    return placed, blocks.groupBy("file").agg(F.min_by("__top", "__block").alias("__first"), F.sum("__size").alias("__lines"))


def csv_file_metrics(
    spark: SparkSession, paths: str | Sequence[str], stage: str | None = None, units: Mapping[str, str] = DEFAULT_UNITS
) -> DataFrame:
    """:func:`csv_metrics` of files of any size, with the path in ``file``; a file is read by as many tasks as it has blocks.

    A file without rows gives no metrics; line ends are those of any system.
    """
    lines, heads = _placed_lines(spark, paths, blank=False)
    heads = heads.select("file", _csv_cells(F.col("__first")).alias("__header"), (F.col("__lines") - 1).alias("__n"))
    rows = lines.where("__at > 0").join(heads, "file")
    rows = rows.select("file", "__header", "__n", (F.col("__at") - 1).alias("__row"), _csv_cells(F.col("__line")).alias("__cells"))
    return _csv_rows(rows, ["file"], stage, units)


def _tsv_fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _tsv_header(line: Column) -> Column:
    return _tsv_fields(F.regexp_replace(line, "# ", ""))


def tsv_file_metrics(
    spark: SparkSession,
    paths: str | Sequence[str],
    index: Column | str,
    stage: str | None = None,
    units: Mapping[str, str] = DEFAULT_UNITS,
) -> DataFrame:
    """:func:`tsv_metrics` of files of any size, with the path in ``file``; ``index`` may be made from that column.

    Only the first line of a file and the first row that fits travel. A file without that row fails the query,
    one without any line gives nothing.
    """
    lines, heads = _placed_lines(spark, paths, blank=True)
    wanted = (index if isinstance(index, Column) else F.lit(index)).cast("string")
    fits = lines.where("__at > 0").where(F.get(_tsv_fields(F.col("__line")), F.lit(0)) == wanted)
    found = fits.groupBy("file").agg(F.min_by("__line", "__at").alias("__line"))
    joined = heads.join(found, "file", "left").select("file", _tsv_header(F.col("__first")).alias("__header"), _tsv_fields(F.col("__line")).alias("__fields"))
    return _tsv_row(joined, ["file"], stage, units)


def tsv_metrics(
    files: DataFrame,
    text: str,
    keys: Sequence[str],
    index: Column | str,
    stage: str | None = None,
    units: Mapping[str, str] = DEFAULT_UNITS,
) -> DataFrame:
    """The first row whose first field is the index, under a ``# `` header; its other fields are the metrics."""
    wanted = (index if isinstance(index, Column) else F.lit(index)).cast("string")
    lines = F.split(col(text), r"\r?\n")
    header = _tsv_header(F.get(lines, F.lit(0)))
    rows = F.transform(F.slice(lines, F.lit(2), F.size(lines)), _tsv_fields)
    found = F.filter(rows, lambda fields: F.get(fields, F.lit(0)) == F.col("__index"))
    parsed = files.select(*cols(keys), col(text), wanted.alias("__index"))
    parsed = parsed.select(*cols(keys), header.alias("__header"), F.get(found, F.lit(0)).alias("__fields"))
    return _tsv_row(parsed, keys, stage, units)


def _tsv_row(parsed: DataFrame, keys: Sequence[str], stage: str | None, units: Mapping[str, str]) -> DataFrame:
    """Metrics of the row that was found, ``__fields``, under ``__header``."""
    row = F.when(F.col("__fields").isNotNull(), F.col("__fields")).otherwise(F.raise_error(F.lit("index not found in tsv text")))
    fields = _last_of_name(explode_rows(parsed, cols([*keys, "__header"]), row, "__field", "__i").where("__i > 0"))
    return _finish(fields, keys, F.get("__header", F.col("__i")), F.col("__field"), stage, None, units)


def _path_tree(paths: Sequence[str]) -> dict:
    """Steps shared by several paths once: step -> tree, and under None the (order, literal name) of paths that end there."""
    tree: dict = {}
    for order, path in enumerate(paths):
        at = tree
        steps = path.split(".")
        for step in steps:
            at = at.setdefault(step, {})
        at.setdefault(None, []).append((order, None if "*" in steps else steps[-1]))
    return tree


def _walk(tree: dict, node: Column, name: Column, at: str) -> Column:
    """What the paths of a tree find below a node, with the order of the path as tag and the metric name as path; a step that isn't there fails."""
    def under(below: dict, place: str, value, key):
        """The paths of the tree below, for a node and the name so far."""
        return lambda one: _walk(below, value(one), key(one), place)

    fields = fields_of(node)
    found = []
    for step, below in tree.items():
        if step is None:
            for order, own in below:
                named = name if own is None else F.lit(own)
                found.append(F.array(entry(F.lit(order), named, node)))
            continue
        place = f"{at}.{step}" if at else step
        if step == "*":
            missing = F.raise_error(F.lit(f"no object under the metric path {place}")).cast("map<string,variant>")
            named = lambda entry: F.when(name == "", entry["key"]).otherwise(F.concat(name, F.lit("."), entry["key"]))
            entries = F.map_entries(F.coalesce(fields, missing))
            found.append(F.flatten(F.transform(entries, under(below, place, lambda entry: entry["value"], named))))
        else:
            plain = not set(step) & set("\"\\'[]")
            child = F.try_variant_get(node, f'$["{step}"]', "variant") if plain else F.try_element_at(fields, F.lit(step))
            missing = F.raise_error(F.lit(f"metric path {place} not found")).cast("variant")
            one = F.array(F.coalesce(child, missing))
            found.append(F.flatten(F.transform(one, under(below, place, lambda own: own, lambda _: name))))
    return (found[0] if len(found) == 1 else F.concat(*found)).cast(FOUND)


def json_metrics(
    documents: DataFrame,
    document: str,
    keys: Sequence[str],
    paths: Sequence[str],
    stage: str | None = None,
    units: Mapping[str, str] = DEFAULT_UNITS,
) -> DataFrame:
    """Values under wildcard paths ``a.*.b``.

    The name joins what each ``*`` stands for; without a wildcard it is the last
    key. An object or list under the path adds its inner names. A later path replaces a
    metric of the same name. A JSON text is a text, also if it looks like a number. A key of a
    path that a document doesn't have, or a ``*`` on something else than an object, fails the query; a
    document that is null gives no rows. Paths are walked together, so the rest of a document is
    never looked at; it is one projection and one generator, without a shuffle, for any depth.
    """
    separator = "\x1f"
    is_text = documents.schema[document].dataType.typeName() == "string"
    text = col(document) if is_text else F.to_json(col(document))
    node = F.parse_json(col(document)) if is_text else col(document)
    read = documents.where(col(document).isNotNull()).select(*cols(keys), node.alias("__node"), nesting_bound(text).alias("__most"))
    step = lambda path, part: F.concat(path, F.lit("."), part)
    found = unfold(_walk(_path_tree(paths), F.col("__node"), F.lit(""), ""), F.col("__most"), step, step)
    # By name, the last path last: what the next entry repeats is replaced.
    sized = read.select(*cols(keys), (F.array_sort(found, _by_name) if len(paths) > 1 else found).alias("__found"))
    nxt = lambda i: F.get(F.col("__found"), i + 1)["path"]
    last = F.filter("__found", lambda e, i: ~nxt(i).eqNullSafe(e["path"])) if len(paths) > 1 else F.col("__found")
    rows = explode_rows(sized, cols(keys), last, "m")
    kind = F.schema_of_variant("m.node")
    # The kind goes with the value: a mark that no number has stands before a text.
    plain = variant_text(F.col("m.node"))
    value = F.when(kind == "STRING", F.concat(F.lit(separator), plain)).otherwise(plain)
    done = _finish(rows.select(*cols(keys), F.col("m.path").alias("__name"), value.alias("value")), keys, F.col("__name"), F.col("value"), stage, None, units)
    return done.withColumn("value_str", F.regexp_replace("value_str", f"^{separator}", ""))


def _by_name(x: Column, y: Column) -> Column:
    less = (x["path"] < y["path"]) | ((x["path"] == y["path"]) & (x["tag"] < y["tag"]))
    same = (x["path"] == y["path"]) & (x["tag"] == y["tag"])
    return F.when(less, -1).when(same, 0).otherwise(1)


def regex_metrics(
    files: DataFrame,
    text: str,
    keys: Sequence[str],
    pattern: str,
    value_group: str,
    name_group: str | None = None,
    stage: str | None = None,
    units: Mapping[str, str] = DEFAULT_UNITS,
) -> DataFrame:
    """All matches of a pattern with named groups; without a name group they are ``match_<i>``.

    The last match of a name counts. Group names are Python's: Java allows no ``_``
    in them, so groups are plain ones there, read by their number.
    """
    group = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    java = "(?m)" + re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{group[m[1]]})", plain)
    every = lambda name: F.regexp_extract_all(col(text), F.lit(java), F.lit(group[name]))
    if not name_group:
        parsed = files.select(*cols(keys), every(value_group).alias("__values"))
        rows = explode_rows(parsed, cols(keys), F.col("__values"), "__value", "__i")
        name = F.concat(F.lit("match_"), F.col("__i").cast("string"))
        return _finish(rows, keys, name, F.col("__value"), stage, None, units)
    names = F.transform(every(name_group), lambda n: F.trim(n))
    parsed = files.select(*cols(keys), names.alias("__names"), every(value_group).alias("__values"))
    parsed = parsed.select(*cols(keys), "__names", F.reverse("__names").alias("__back"), "__values")
    last = lambda n: F.get("__values", (F.size("__names") - F.array_position("__back", n)).cast("int"))
    found = F.transform(F.array_distinct("__names"), lambda n: F.struct(n.alias("name"), last(n).alias("value")))
    rows = explode_rows(parsed, cols(keys), found, "__m", "__i")
    return _finish(rows, keys, F.col("__m.name"), F.col("__m.value"), stage, None, units)


def merge_stages(stages: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Metrics of several stages; a later stage replaces a metric of the same name."""
    fields = ["value", "value_str", "unit"]
    rows = [s.select(*cols(keys), "name", F.lit(i).alias("__stage"), F.struct(*fields).alias("__m")) for i, s in enumerate(stages)]
    merged = reduce(DataFrame.unionByName, rows).groupBy(*cols(keys), "name").agg(F.max_by("__m", "__stage").alias("__m"))
    return merged.select(*cols(keys), "name", "__m.*")


@dataclass(frozen=True)
class CustomVariable:
    name: str
    op: str
    columns: tuple[str, ...]
    unit: str = "s"


def _combine(op: str, values: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, values)
    if op == "sum":
        return total
    if op == "mean":
        return total / len(values)
    if op in ("min", "max"):
        pick = F.least if op == "min" else F.greatest
        return values[0] if len(values) == 1 else pick(*values)
    raise ValueError(f"operation {op} is not implemented")


def custom_variables(
    metrics: DataFrame, keys: Sequence[str], variables: Sequence[CustomVariable], missing: str = "raise"
) -> DataFrame:
    """New metrics per case from named ones; a later variable may use an earlier one.

    One grouping collects the inputs of all variables. A case that lacks an input
    is an error, or has a null value with ``missing="null"``.
    """
    made = {v.name for v in variables}
    inputs = sorted({c for v in variables for c in v.columns if c not in made})
    picked = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"__in_{i}") for i, n in enumerate(inputs)]
    wide = metrics.groupBy(*cols(keys)).agg(*picked)
    known: dict[str, Column] = {n: F.col(f"__in_{i}") for i, n in enumerate(inputs)}
    for i, variable in enumerate(variables):
        unknown = [c for c in variable.columns if c not in known]
        if unknown:
            raise ValueError(f"custom variable {variable.name} uses {unknown} before they exist")
        values = [known[c] for c in variable.columns]
        complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
        other = F.raise_error(F.lit(f"custom variable not found: {variable.name}")) if missing == "raise" else F.lit(None)
        wide = wide.withColumn(f"__out_{i}", F.when(complete, _combine(variable.op, values)).otherwise(other.cast("double")))
        known[variable.name] = F.col(f"__out_{i}")
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(v.name).alias("name"), F.col(f"__out_{i}").alias("value"), F.lit(v.unit).alias("unit"))
                for i, v in enumerate(variables)
            ]
        )
    )
    return wide.select(*cols(keys), rows.alias("__row")).select(*cols(keys), "__row.*")


def check_logs(
    logs: DataFrame, text: str, keys: Sequence[str], success: Sequence[str] = (), errors: Sequence[str] = ()
) -> DataFrame:
    """Per group of log texts: every success text found, no error text found, and both.

    The texts are literals. A null log holds nothing.
    """
    log = F.coalesce(col(text), F.lit(""))
    found = reduce(lambda a, b: a & b, [F.contains(log, F.lit(s)) for s in success], F.lit(True))
    failed = reduce(lambda a, b: a | b, [F.contains(log, F.lit(e)) for e in errors], F.lit(False))
    grouped = logs.groupBy(*cols(keys)).agg(F.bool_and(found).alias("success"), F.bool_and(~failed).alias("no_errors"))
    return grouped.withColumn("passed", F.col("success") & F.col("no_errors"))
