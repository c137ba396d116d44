"""Chart transformations and the series drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.catalogue.registry import Tables, query
from gaugeframe.operators import series, transforms
from gaugeframe.operators.ordinals import cycle, dense_codes, row_suffix
from gaugeframe.operators.transforms import Axes

AXES = Axes(x="l_linenumber", color="l_returnflag", y="l_extendedprice", secondary="l_linestatus")
STEPS = [("l_shipdate", "sum")]
CELLS = """(SELECT l_linestatus, l_linenumber, l_returnflag, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL)"""


def rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


@query("performance", f"SELECT l_linestatus, l_linenumber, l_returnflag, round(y, 2) AS l_extendedprice FROM {CELLS}")
def performance(t: Tables) -> DataFrame:
    return rounded(transforms.performance(t("lineitem"), AXES, STEPS), "l_extendedprice", 2)


@query(
    "relative_performance",
    f"""SELECT l_linestatus, l_linenumber, l_returnflag,
        round(100 * y / sum(y) OVER (PARTITION BY l_linestatus, l_linenumber), 6) AS l_extendedprice FROM {CELLS}""",
)
def relative_performance(t: Tables) -> DataFrame:
    return rounded(transforms.relative_performance(t("lineitem"), AXES, STEPS), "l_extendedprice", 6)


def speedup_sql(cells: str, outer: str, x: str, color: str, digits: int = 6) -> str:
    """Window form of the speedup, with the guide lines as two more series."""
    lead = f"{outer}, " if outer else ""
    part = f"PARTITION BY {outer}" if outer else ""
    series = f"PARTITION BY {lead}{color}"
    return f"""WITH c AS (SELECT *, min({x}) OVER ({part}) AS x0 FROM {cells}),
      b AS (SELECT *, max(CASE WHEN {x} = x0 THEN y END) OVER ({series}) AS y0 FROM c),
      p AS (SELECT DISTINCT {lead}{x}, x0 FROM c)
      SELECT {lead}{x}, {color}, round(y0 / nullif(y, 0), {digits}) AS y FROM b
      UNION ALL SELECT {lead}{x}, 'optimal', round({x} / nullif(x0, 0), {digits}) FROM p
      UNION ALL SELECT {lead}{x}, 'half-optimal', round(({x} / nullif(x0, 0) - 1) / 2 + 1, {digits}) FROM p"""


@query("speedup", speedup_sql(CELLS, "l_linestatus", "l_linenumber", "l_returnflag"))
def speedup(t: Tables) -> DataFrame:
    speeds = transforms.speedup(t("lineitem"), AXES, STEPS).withColumnRenamed("l_extendedprice", "y")
    return rounded(speeds, "y", 6)


FLAT = Axes(x="l_linenumber", color="l_returnflag", y="l_quantity")


@query(
    "speedup_single",
    speedup_sql(
        "(SELECT l_linenumber, l_returnflag, max(q) AS y FROM (SELECT l_linenumber, l_returnflag, l_suppkey, "
        "sum(l_quantity) AS q FROM (SELECT * REPLACE (CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 8 ELSE l_linenumber END AS l_linenumber) FROM lineitem) GROUP BY ALL) GROUP BY ALL)",
        "", "l_linenumber", "l_returnflag",
    ),
)
def speedup_single(t: Tables) -> DataFrame:
    """One index axis, and a series without a row at the smallest x: its speedup is null."""
    moved = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"), 8).otherwise(F.col("l_linenumber"))
    rows = t("lineitem").withColumn("l_linenumber", moved)
    speeds = transforms.speedup(rows, FLAT, [("l_shipdate", "sum"), ("l_suppkey", "max")])
    return rounded(speeds.withColumnRenamed("l_quantity", "y"), "y", 6)


EXTRA = Axes(x="l_linenumber", color="l_returnflag", y="l_quantity", secondary="l_linestatus", extras=("l_tax",))
EXTRA_CELLS = "(SELECT l_linestatus, l_linenumber, l_tax, l_returnflag, sum(l_quantity) AS y FROM lineitem GROUP BY ALL)"


@query("speedup_multi", speedup_sql(EXTRA_CELLS, "l_linestatus, l_tax", "l_linenumber", "l_returnflag"))
def speedup_multi(t: Tables) -> DataFrame:
    speeds = transforms.speedup(t("lineitem"), EXTRA, [("l_shipdate", "sum")]).withColumnRenamed("l_quantity", "y")
    return rounded(speeds, "y", 6)


@query(
    "transform_dispatch",
    """SELECT o_orderpriority, o_orderstatus, round(100 * y / sum(y) OVER (PARTITION BY o_orderpriority), 6) AS value
       FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority,
       o_orderstatus, count(*) AS y FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL)""",
)
def transform_dispatch(t: Tables) -> DataFrame:
    """Default y axis, an axis filter with a label, and the transformation chosen by name."""
    labels = {"o_orderpriority": {"1-URGENT": "urgent", "2-HIGH": "2-HIGH", "5-LOW": "5-LOW"}}
    axes = Axes(x="o_orderpriority", color="o_orderstatus", labels=labels)
    rows = t("orders").withColumnRenamed("o_totalprice", "value")
    shares = transforms.transform(rows, "relative_performance", axes, [("o_orderkey", "count")])
    return rounded(shares, "value", 6)


@query(
    "factorize",
    """SELECT p_partkey, p_brand, coalesce(code, -1) AS code FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand END
       AS p_brand FROM part) LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code
       FROM part WHERE p_size > 5 GROUP BY p_brand) USING (p_brand)""",
)
def factorize(t: Tables) -> DataFrame:
    parts = t("part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_brand")).alias("p_brand"))
    return dense_codes(parts, "p_brand", "code", order_by="p_partkey")


@query(
    "mark_cycle",
    f"""SELECT doc_id, source, code, list_extract({series.MARKS}, CAST(code % 22 AS INTEGER) + 1) AS mark
        FROM (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents)""",
)
def mark_cycle(t: Tables) -> DataFrame:
    coded = dense_codes(t("documents").select("doc_id", "source"), "source", "code")
    return coded.withColumn("mark", cycle(F.col("code"), series.MARKS))


@query(
    "row_suffix",
    """SELECT event_id, CASE WHEN count(*) OVER w > 1 THEN event_type || '_' ||
       (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) ELSE event_type END AS name
       FROM events WINDOW w AS (PARTITION BY user_id, event_type)""",
)
def row_suffix_query(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "user_id", "event_type")
    return row_suffix(events, ["user_id"], "event_type", "event_id", "name").select("event_id", "name")


# Whole-number cells, so that every series below is exact.
COUNTS = Axes(x="l_linenumber", color="l_returnflag", y="l_quantity", secondary="l_linestatus")
COUNT_CELLS = "(SELECT l_linestatus, l_linenumber, l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"


def count_cells(t: Tables, axes: Axes = COUNTS) -> DataFrame:
    return transforms.performance(t("lineitem"), axes, [("l_shipdate", "sum")])


@query(
    "ser_scatter",
    speedup_sql(COUNT_CELLS.replace("AS l_quantity", "AS y"), "l_linestatus", "l_linenumber", "l_returnflag")
    .replace("AS y FROM b", "AS y, false AS is_guide FROM b")
    .replace("FROM p", ", true FROM p"),
)
def ser_scatter(t: Tables) -> DataFrame:
    speeds = transforms.speedup(t("lineitem"), COUNTS, [("l_shipdate", "sum")])
    return rounded(series.scatter(speeds, COUNTS, "speedup").withColumnRenamed("l_quantity", "y"), "y", 6)


@query(
    "ser_marked",
    f"""SELECT *, list_extract({series.MARKS}, CAST(mark_index % 22 AS INTEGER) + 1) AS mark,
        list_extract({series.COLORS}, CAST(color_index % 34 AS INTEGER) + 1) AS color FROM (
        SELECT *, false AS is_guide, dense_rank() OVER (PARTITION BY l_linestatus ORDER BY first_x, l_tax) - 1 AS mark_index,
        dense_rank() OVER (ORDER BY l_returnflag) - 1 AS color_index FROM (
        SELECT l_linestatus, l_linenumber, l_tax, l_returnflag, y AS l_quantity,
        min(l_linenumber) OVER (PARTITION BY l_linestatus, l_tax) AS first_x FROM {EXTRA_CELLS})) """.replace(
        "SELECT *, list_extract", "SELECT * EXCLUDE (first_x), list_extract", 1
    ),
)
def ser_marked(t: Tables) -> DataFrame:
    return series.marked_scatter(count_cells(t, EXTRA), EXTRA)


@query(
    "ser_marked_two",
    f"""SELECT *, false AS is_guide, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS mark_index,
        dense_rank() OVER (ORDER BY l_returnflag) - 1 AS color_index,
        list_extract({series.MARKS}, CAST(dense_rank() OVER (ORDER BY l_linestatus) AS INTEGER)) AS mark,
        list_extract({series.COLORS}, CAST(dense_rank() OVER (ORDER BY l_returnflag) AS INTEGER)) AS color
        FROM {COUNT_CELLS}""",
)
def ser_marked_two(t: Tables) -> DataFrame:
    return series.marked_scatter(count_cells(t), COUNTS)


def _flags_sql(value: str) -> str:
    return ", ".join(f"max({value}) FILTER (l_returnflag = '{f}') AS \"{f}\"" for f in "ANR")


# Three significant digits of a whole number: half of the last kept step rounds up.
SHORT = "floor(l_quantity / pow(10, floor(log10(l_quantity)) - 2) + 0.5) * pow(10, floor(log10(l_quantity)) - 2)"


@query("ser_table", f"SELECT l_linestatus, l_linenumber, {_flags_sql(SHORT)} FROM {COUNT_CELLS} GROUP BY ALL")
def ser_table(t: Tables) -> DataFrame:
    return series.table_figure(count_cells(t), COUNTS, ["A", "N", "R"])


@query(
    "ser_stacked",
    f"""SELECT l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_quantity,
        sum(l_quantity) OVER (PARTITION BY l_linestatus, l_linenumber ORDER BY l_returnflag) AS stack_top
        FROM {COUNT_CELLS}""",
)
def ser_stacked(t: Tables) -> DataFrame:
    return series.stacked_bar(count_cells(t), COUNTS)


@query(
    "ser_grouped",
    f"SELECT l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_quantity FROM {COUNT_CELLS}",
)
def ser_grouped(t: Tables) -> DataFrame:
    return series.grouped_bar(count_cells(t), COUNTS)


@query(
    "ser_heatmap",
    "SELECT l_linestatus, l_returnflag, "
    + ", ".join(f'max(l_quantity) FILTER (l_linenumber = {n}) AS "{n}"' for n in range(1, 8))
    + f" FROM {COUNT_CELLS} GROUP BY ALL",
)
def ser_heatmap(t: Tables) -> DataFrame:
    return series.heatmap(count_cells(t), COUNTS, [1, 2, 3, 4, 5, 6, 7])


@query(
    "sunburst",
    """SELECT 1 AS depth, l_linestatus AS id, '' AS parent, sum(l_quantity) AS total FROM lineitem GROUP BY ALL
       UNION ALL SELECT 2, l_linestatus || '/' || l_linenumber, l_linestatus, sum(l_quantity) FROM lineitem GROUP BY ALL
       UNION ALL SELECT 3, l_linestatus || '/' || l_linenumber || '/' || l_returnflag,
       l_linestatus || '/' || l_linenumber, sum(l_quantity) FROM lineitem GROUP BY ALL""",
)
def sunburst(t: Tables) -> DataFrame:
    return series.sunburst(count_cells(t), COUNTS)


@query(
    "ser_parallel",
    f"""SELECT *, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus_code, l_linenumber AS l_linenumber_code,
        dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag_code FROM {COUNT_CELLS}""",
)
def ser_parallel(t: Tables) -> DataFrame:
    return series.parallel_coordinates(count_cells(t), COUNTS)


@query(
    "ser_3d",
    f"""SELECT l_linestatus AS frame, l_linenumber AS x, l_tax AS y, l_quantity AS z, l_returnflag AS series
        FROM {EXTRA_CELLS.replace("AS y", "AS l_quantity")}""",
)
def ser_3d(t: Tables) -> DataFrame:
    return series.points_3d(count_cells(t, EXTRA), EXTRA)


@query(
    "ser_frames",
    f"""SELECT l_linestatus, low, high, frame, 'frame_' || frame AS name FROM (SELECT l_linestatus,
        min(l_quantity) - min(l_quantity) * 0.01 AS low, max(l_quantity) + min(l_quantity) * 0.01 AS high,
        row_number() OVER (ORDER BY l_linestatus) - 1 AS frame FROM {COUNT_CELLS} GROUP BY l_linestatus)""",
)
def ser_frames(t: Tables) -> DataFrame:
    return series.slider_frames(count_cells(t), COUNTS)
