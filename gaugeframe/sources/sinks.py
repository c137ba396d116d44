"""Exports: csv tables, chart data, delimited lines, log pages.

Every sink writes a folder with a file per task, so no export passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, explode_rows, text_of
from gaugeframe.functions.scalars import sanitize
from gaugeframe.functions.text import latex_escape
from gaugeframe.operators.aggregates import spread
from gaugeframe.operators.ordinals import group_ordinals, running_total
from gaugeframe.operators.transforms import Axes
from gaugeframe.session import scratch_dir


def figure_table(cells: DataFrame, axes: Axes, levels: Sequence[Any]) -> DataFrame:
    """The pivoted table of a figure: index columns and one column per series."""
    return spread(cells, axes.index, axes.color, axes.y, levels, strict=True)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_csv_by(table: DataFrame, outer: str, path: str) -> None:
    """One folder per outer key, named by its file-safe form.

    Rows are dealt by key first, so a key has one file, or several if it is large,
    and not one of every task.
    """
    named = table.withColumn("figure", sanitize(text_of(table, outer)))
    named.repartitionByRange("figure", F.xxhash64(*cols(table.columns))).write.mode("overwrite").option("header", True).partitionBy("figure").csv(path)


def chart_traces(cells: DataFrame, axes: Axes) -> DataFrame:
    """``(outer…, series, position, x, y)``: the points of every series in the order of x.

    One shape at every size: a trace is its rows in the order of the position.
    """
    group = [*axes.outer, axes.color]
    placed = group_ordinals(cells, group, axes.x, "position")
    return placed.select(*cols(group), "position", col(axes.x).alias("x"), col(axes.y).alias("y"))


def write_chart_json(cells: DataFrame, axes: Axes, path: str) -> None:
    """JSON lines, sorted by series and position within the files; a hot series fills several files."""
    group = [*cols(axes.outer), col(axes.color)]
    traces = chart_traces(cells, axes).repartitionByRange(*group, "position").sortWithinPartitions(*group, "position")
    traces.write.mode("overwrite").json(path)


def table_lines(df: DataFrame, style: str = "adoc") -> DataFrame:
    """Rows as ``|cell|cell`` or as ``cell & cell \\\\`` with LaTeX escapes."""
    cells = [F.coalesce(text_of(df, c), F.lit("nan")) for c in df.columns]
    if style == "adoc":
        line: Column = F.concat(*[F.concat(F.lit("|"), c) for c in cells])
    elif style == "tex":
        line = F.concat(F.concat_ws(" & ", *[latex_escape(c) for c in cells]), F.lit(" \\\\"))
    else:
        raise ValueError(f"unknown table style: {style}")
    return df.select(line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_json_lists(documents: DataFrame, key: str, document: str, path: str, files: int) -> None:
    """JSON documents (texts of any number of lines) as ``files`` files, each one list in the order of a unique key.

    The number of files follows what the caller knows of the size and not the number of documents. Rows are
    dealt by the key's hash, so neither gaps nor a run of keys make files uneven. Documents must not be null.
    """
    part = F.pmod(F.xxhash64(col(key)), F.lit(files)).cast("int")
    dealt = documents.select(part.alias("part"), col(key).alias("__key"), col(document).alias("value"))
    in_file = Window.partitionBy("part").orderBy("__key")
    before = F.when(F.row_number().over(in_file) == 1, F.lit("[")).otherwise(F.lit(","))
    after = F.when(F.lead("part").over(in_file).isNull(), F.lit("\n]")).otherwise(F.lit(""))
    lines = dealt.withColumn("value", F.concat(before, F.lit("\n"), F.col("value"), after))
    # The number of rows at once doesn't split a list: a file ends with its part.
    writer = lines.sortWithinPartitions("part", "__key").select("part", "value").write.mode("overwrite")
    writer.option("maxRecordsPerFile", 0).partitionBy("part").text(path)


# Section titles of a log page in page order.
LOG_SECTIONS = {"script": "Scheduler script", "error_log": "Error log", "output_log": "Output log"}


def log_sections(cases: DataFrame, logs: DataFrame, key: str, kind: str = "kind", text: str = "text") -> DataFrame:
    """The log page of every case as ``(key, rank, kind, value)`` section rows; empty logs are skipped.

    Standard sections come first. Other kinds are custom logs, titled by their
    name and shown only for a case with an output log. Sections stay rows, so a
    case with many logs is never gathered into one text.
    """
    order = list(LOG_SECTIONS)
    known = F.array_position(F.array(*map(F.lit, order)), col(kind))
    rank = F.when(known == 0, F.lit(len(order) + 1)).otherwise(known).cast("int")
    title = F.coalesce(F.create_map(*[F.lit(x) for p in LOG_SECTIONS.items() for x in p])[col(kind)], col(kind))
    body = F.concat(F.lit("== "), title, F.lit("\n\n----\n"), col(text), F.lit("\n----\n"))
    filled = logs.where(F.coalesce(col(text), F.lit("")) != "").join(cases.select(col(key)), key, "left_semi")
    sections = filled.select(col(key), rank.alias("rank"), col(kind).alias("kind"), body.alias("value"))
    with_output = filled.where(col(kind) == "output_log").select(col(key)).distinct()
    standard = sections.where(F.col("rank") <= len(order))
    custom = sections.where(F.col("rank") > len(order)).join(with_output, key, "left_semi")
    head = cases.select(col(key), F.lit(0).alias("rank"), F.lit("head").alias("kind"), F.lit("= Logs\n").alias("value"))
    return head.unionByName(standard).unionByName(custom)


# Bytes after which a file of log pages is full; it ends with the section that fills it.
PAGE_FILE_BYTES = 16 * 1024 * 1024


def write_log_pages(sections: DataFrame, key: str, path: str, file_bytes: int = PAGE_FILE_BYTES) -> None:
    """The pages of all cases one after the other, packed into text files of bounded size, with an index.

    ``pages/file=<n>`` holds one file each, so their number follows the bytes and not the cases; a long page
    goes on in the next file. ``index`` has a row per section: ``(key, rank, kind, file, offset, length)`` in bytes.
    A section with a null text is empty. Sections are placed once and stored, as files and index must agree.
    """
    spark = sections.sparkSession
    value = F.coalesce("value", F.lit(""))
    # Sections that are alike in all of this are interchangeable.
    order = F.struct(col(key), F.col("rank"), F.col("kind"), F.sha2(value, 256).alias("digest"))
    size = (F.octet_length(value) + 1).cast("bigint")  # the line end counts
    sized = sections.select(col(key), "rank", "kind", value.alias("value"), order.alias("__order"), size.alias("__size"))
    ends = running_total(sized, [], "__order", "__size", "__end", width=10_000)
    start = F.col("__end") - F.col("__size")
    in_files = ends.withColumn("__start", start).withColumn("file", F.call_function("div", start, F.lit(file_bytes).cast("bigint")))
    offset = F.col("__start") - F.min("__start").over(Window.partitionBy("file"))
    placed = in_files.select(col(key), "rank", "kind", "value", "file", offset.alias("offset"), (F.col("__size") - 1).alias("length"))
    stored = scratch_dir(spark, "log-pages")
    placed.write.parquet(stored)
    rows = spark.read.schema(placed.schema).parquet(stored)
    texts = rows.repartition("file").sortWithinPartitions("file", "offset").select("file", "value")
    texts.write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("file").text(f"{path}/pages")
    rows.drop("value").repartitionByRange(col(key)).sortWithinPartitions(col(key), "rank").write.mode("overwrite").parquet(f"{path}/index")


def read_log_pages(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The sections of written pages, or of those whose index rows pass ``where``.

    A file meets its part of the index, which its size bounds, and is cut by bytes; files without a wanted section
    drop out in the join.
    """
    index = spark.read.parquet(f"{path}/index")
    wanted = index if where is None else index.where(where)
    cuts = wanted.groupBy("file").agg(F.collect_list(F.struct(*cols(c for c in index.columns if c != "file"))).alias("__cuts"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/pages")
    number = F.col("file") if "file" in files.columns else F.lit(None)  # no page, no folder
    joined = files.select(number.cast("bigint").alias("file"), "content").join(cuts, "file")
    names = [c for c in index.columns if c not in ("file", "offset", "length")]
    cut = lambda data, c: F.decode(F.substring(data, (c["offset"] + 1).cast("int"), c["length"].cast("int")), "UTF-8")
    section = lambda data: lambda c: F.struct(*[c[n].alias(n) for n in names], cut(data, c).alias("value"))
    # The bytes are taken out of the row once, as an item of an array: a column would be copied whole for every section.
    sliced = F.get(F.transform(F.array("content"), lambda data: F.transform("__cuts", section(data))), F.lit(0))
    return explode_rows(joined, [], sliced, "__section").select(*[F.col("__section")[n].alias(n) for n in [*names, "value"]])
