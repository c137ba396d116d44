"""Run reports, summaries, hierarchies, metrics and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.catalogue.registry import Tables, query
from gaugeframe.operators import grids, hierarchy, metrics, runs
from gaugeframe.operators.grids import Parameter
from gaugeframe.operators.metrics import CustomVariable
from gaugeframe.session import scratch_dir

# ---------------------------------------------------------------- run reports
# Every order is a report of one run with three cases: one with two metrics and
# object parameters, one with a single text metric, one without metrics.


REPORT = (
    '{"session_info":{"hostname":"node","num_cases":3},"runs":[{"run_index":%d,"num_cases":3,"num_failures":%d,"testcases":['
    '{"hashcode":"h0-%d","system":"gaia","partition":"public","result":"%s","time_total":%s,'
    '"check_params":{"tasks":%d,"mem":{"size":"L","gb":%d}},"perfvalues":{'
    '"gaia:public:price":[%s,1.0,-0.1,0.1,"s","pass"],"gaia:public:rank":[%d,0,null,null,"rows","fail"]}},'
    '{"hashcode":"h1-%d","system":"gaia","partition":"public","result":"%s","time_total":%s,'
    '"check_params":{"tasks":%d},"perfvalues":{"gaia":["%s",0,null,null,"text","pass"]}},'
    '{"hashcode":"h2-%d","system":"gaia","partition":"public","result":"fail","time_total":%s,'
    '"check_params":{"tasks":0},"perfvalues":{}}]}]}'
)


def order_reports(t: Tables) -> DataFrame:
    """``(leaf, report)``: the order written as the JSON text of a run report."""
    key, passed = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    result, time = F.when(passed, "pass").otherwise("fail"), (key / 4).cast("string")
    report = F.format_string(
        REPORT,
        key % 2, F.when(passed, 1).otherwise(3),
        key, result, time, key % 8, key % 3, F.col("o_totalprice").cast("string"), key % 100,
        key, result, time, key % 8 + 8, F.col("o_orderpriority"),
        key, time,
    )
    return t("orders").select(F.concat(F.lit("leaf-"), key.cast("string")).alias("leaf"), report.alias("report"))


def order_facts(t: Tables) -> DataFrame:
    return runs.run_facts(runs.parse_reports(order_reports(t), "report"))


ORDER_FACTS = """(SELECT 'leaf-' || o_orderkey AS leaf, m.*, 'gaia' AS system,
    o_orderkey / 4 AS "testcases.time_total", 'h' || m.i || '-' || o_orderkey AS "testcases.hashcode",
    CASE WHEN m.i = 2 OR o_orderstatus <> 'F' THEN 'fail' ELSE 'pass' END AS "testcases.result",
    o_orderkey % 2 AS "runs.run_index", 3 AS "runs.num_cases",
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 3 END AS "runs.num_failures"
    FROM orders, LATERAL (
      SELECT 0 AS i, 'price' AS perfvalue, o_totalprice AS value, NULL AS value_str, 1.0::DOUBLE AS reference,
        -0.1::DOUBLE AS low_threshold, 0.1::DOUBLE AS up_threshold, 's' AS unit, 'pass' AS result, 'public' AS partition,
        (o_orderkey % 8)::VARCHAR AS tasks, 'L' AS "mem.size", (o_orderkey % 3)::VARCHAR AS "mem.gb"
      UNION ALL SELECT 0, 'rank', o_orderkey % 100, NULL, 0, NULL, NULL, 'rows', 'fail', 'public',
        (o_orderkey % 8)::VARCHAR, 'L', (o_orderkey % 3)::VARCHAR
      UNION ALL SELECT 1, NULL, NULL, o_orderpriority, 0, NULL, NULL, 'text', 'pass', NULL,
        (o_orderkey % 8 + 8)::VARCHAR, NULL, NULL
      UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'fail', 'public', '0', NULL, NULL) m)"""


@query(
    "run_facts",
    f"""SELECT * EXCLUDE (i, tasks, "mem.size", "mem.gb"), 'gaia' AS "testcases.system",
        'public' AS "testcases.partition" FROM {ORDER_FACTS}""",
)
def run_facts(t: Tables) -> DataFrame:
    return order_facts(t).drop("params")


@query("metric_key_split", f"SELECT leaf, system, partition, perfvalue FROM {ORDER_FACTS}")
def metric_key_split(t: Tables) -> DataFrame:
    """A case without metrics has a row without a name."""
    return order_facts(t).select("leaf", "system", "partition", "perfvalue")


@query(
    "metric_array_columns",
    f"""SELECT leaf, perfvalue, value, value_str, reference, low_threshold, up_threshold, unit, result
        FROM {ORDER_FACTS}""",
)
def metric_array_columns(t: Tables) -> DataFrame:
    names = ["leaf", "perfvalue", "value", "value_str", *runs.METRIC_SLOTS[1:]]
    return order_facts(t).select(*names)


@query("param_columns", f"""SELECT leaf, perfvalue, tasks, "mem.size", "mem.gb" FROM {ORDER_FACTS}""")
def param_columns(t: Tables) -> DataFrame:
    facts = runs.parameter_columns(order_facts(t), ["tasks", "mem.size", "mem.gb"])
    return facts.select("leaf", "perfvalue", "tasks", "`mem.size`", "`mem.gb`")


@query(
    "empty_report",
    """SELECT o_orderkey, 'total' AS perfvalue, o_totalprice AS value, NULL::VARCHAR AS value_str FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, 'state', NULL, o_orderkey || 'd' FROM orders WHERE o_orderstatus = 'F'""",
)
def empty_report(t: Tables) -> DataFrame:
    """Reports without runs have no rows, the others keep theirs; a text that a cast would read as a number stays one."""
    case = F.format_string(
        '{"runs":[{"run_index":0,"testcases":[{"system":"s","partition":"p","check_params":{},'
        '"perfvalues":{"s:p:total":["%s","0",null,null,"s","pass"],"s:p:state":["%dd","0",null,null,"s","pass"]}}]}]}',
        F.col("o_totalprice").cast("string"), "o_orderkey",
    )
    report = F.when(F.col("o_orderstatus") == "F", case).otherwise(F.lit('{"runs":[]}'))
    facts = runs.run_facts(runs.parse_reports(t("orders").select("o_orderkey", report.alias("report")), "report"))
    return facts.select("o_orderkey", "perfvalue", "value", "value_str")


@query(
    "run_facts_fields",
    """SELECT o_orderkey, 'total' AS perfvalue, o_totalprice AS value, 'c' || o_custkey AS "runs.campaign", o_orderpriority AS "testcases.queue",
       CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'true' END AS flag, '{"n":' || o_orderkey || '}' AS label, '1.5' AS "grid.step" FROM orders""",
)
def run_facts_fields(t: Tables) -> DataFrame:
    """Fields beyond the known ones stay; a flag, a text that reads like one, and a text that reads like an object keep their kind."""
    flag = F.when(F.col("o_orderstatus") == "F", "true").otherwise('"true"')
    case = F.format_string(
        '{"runs":[{"run_index":0,"campaign":"c%d","testcases":[{"system":"s","partition":"p","queue":"%s",'
        '"check_params":{"flag":%s,"label":"{\\"n\\":%d}","grid":{"step":1.50}},"perfvalues":{"s:p:total":["%s","0",null,null,"s","pass"]}}]}]}',
        "o_custkey", "o_orderpriority", flag, "o_orderkey", F.col("o_totalprice").cast("string"),
    )
    reports = t("orders").select("o_orderkey", case.alias("report"))
    fields = runs.discover_fields(reports, "report")
    facts = runs.run_facts(runs.parse_reports(reports, "report", runs.report_schema(*fields)))
    facts = runs.parameter_columns(facts, ["flag", "label", "grid.step"])
    return facts.select("o_orderkey", "perfvalue", "value", "`runs.campaign`", "`testcases.queue`", "flag", "label", "`grid.step`")


@query(
    "case_run_attributes",
    f"""SELECT leaf, "testcases.hashcode", perfvalue, "runs.run_index", "runs.num_cases", "runs.num_failures"
        FROM {ORDER_FACTS}""",
)
def case_run_attributes(t: Tables) -> DataFrame:
    names = ["leaf", "`testcases.hashcode`", "perfvalue", "`runs.run_index`", "`runs.num_cases`", "`runs.num_failures`"]
    return order_facts(t).select(*names)


# ------------------------------------------------- summaries over a hierarchy
# Customers are the leaves, their orders the rows; region, nation and segment are levels.


def customer_facts(t: Tables) -> DataFrame:
    order = F.col("o_orderkey")
    facts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = facts.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return facts.select(
        F.col("c_name").alias("leaves"), F.col("o_orderdate").alias("date"), order.alias("runs.run_index"),
        (order % 7).alias("runs.num_cases"), (order % 3).alias("runs.num_failures"),
        F.when(F.col("o_orderstatus") != "P", "pass").alias("result"), "r_name", "n_name", "c_mktsegment",
    )


FACTS = """(SELECT c_name AS leaves, o_orderdate AS date, o_orderkey, o_orderkey % 7 AS cases, o_orderkey % 3 AS failures,
    CASE WHEN o_orderstatus <> 'P' THEN 'pass' END AS result, r_name, n_name, c_mktsegment FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEAF_SUMMARY = f"""(SELECT leaves, max(o_orderkey) + 1 AS num_runs, min(date) AS date, arg_min(cases, o_orderkey) AS num_cases,
    arg_min(failures, o_orderkey) AS num_failures,
    CASE WHEN bool_and(result IS NOT DISTINCT FROM 'pass') THEN 'pass' ELSE 'fail' END AS result,
    min(r_name) AS r_name, min(n_name) AS n_name, min(c_mktsegment) AS c_mktsegment FROM {FACTS} GROUP BY leaves)"""
SUMMED = """sum(num_runs)::BIGINT AS num_runs, sum(num_cases)::BIGINT AS num_cases, sum(num_failures)::BIGINT AS num_failures,
    arg_max(result, date::VARCHAR || leaves) AS result, max(date)::VARCHAR AS latest,
    arg_max(leaves, date::VARCHAR || leaves) AS latest_leaf"""
LEVELS = ["r_name", "n_name", "c_mktsegment"]


def customer_summary(t: Tables) -> DataFrame:
    return runs.leaf_summary(customer_facts(t), levels=LEVELS)


def dates_as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("leaf_summary", f"SELECT * REPLACE (date::VARCHAR AS date) FROM {LEAF_SUMMARY}")
def leaf_summary(t: Tables) -> DataFrame:
    return dates_as_text(customer_summary(t), "date")


@query(
    "leaf_latest_first",
    f"SELECT leaves, date, result, row_number() OVER (ORDER BY date DESC, leaves DESC) - 1 AS place FROM {LEAF_SUMMARY}",
)
def leaf_latest_first(t: Tables) -> DataFrame:
    leaves = runs.leaf_summary(customer_facts(t))
    return runs.latest_first(leaves).select("leaves", "date", "result", "place")


@query("group_summary", f"SELECT n_name, {SUMMED} FROM {LEAF_SUMMARY} GROUP BY n_name")
def group_summary(t: Tables) -> DataFrame:
    return dates_as_text(runs.group_summary(customer_summary(t), "n_name"), "latest")


@query(
    "latest_15",
    f"""SELECT leaves, min(date)::VARCHAR AS date, max(failures) AS num_failures, min(n_name) AS n_name,
        CASE WHEN max(failures) = 0 THEN '🟢' ELSE '🔴' END AS status FROM {FACTS} GROUP BY leaves
        ORDER BY min(date) DESC, leaves DESC LIMIT 15""",
)
def latest_15(t: Tables) -> DataFrame:
    latest = runs.latest_reports(customer_facts(t), 15, levels=["n_name", "use_cases"])
    return dates_as_text(latest, "date")


@query("rollup_levels", f"""SELECT 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) AS depth, r_name, n_name,
       c_mktsegment, {SUMMED} FROM {LEAF_SUMMARY} GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_levels(t: Tables) -> DataFrame:
    return dates_as_text(hierarchy.roll_up(customer_summary(t), LEVELS, runs.summary_columns()), "latest")


@query(
    "rollup_views",
    f"""SELECT 0 AS view, 2 - (grouping(r_name) + grouping(n_name)) AS depth, r_name, n_name, NULL AS c_mktsegment, {SUMMED}
        FROM {LEAF_SUMMARY} GROUP BY ROLLUP (r_name, n_name) UNION ALL
        SELECT 1, 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)), r_name, n_name, c_mktsegment, {SUMMED}
        FROM {LEAF_SUMMARY} GROUP BY ROLLUP (c_mktsegment, r_name, n_name)""",
)
def rollup_views(t: Tables) -> DataFrame:
    views = [["r_name", "n_name"], ["c_mktsegment", "r_name", "n_name"]]
    return dates_as_text(hierarchy.roll_up_views(customer_summary(t), views, runs.summary_columns()), "latest")


@query(
    "agg_callback",
    f"""SELECT 'root' AS node_type, NULL AS node, count(*) AS leaves, sum(num_runs)::BIGINT AS total FROM {LEAF_SUMMARY}
        UNION ALL SELECT 'region', r_name, count(*), max(num_cases) FROM {LEAF_SUMMARY} GROUP BY r_name""",
)
def agg_callback(t: Tables) -> DataFrame:
    """Aggregates chosen by the level: runs at the root, the largest case count per region."""
    total = {None: F.sum("num_runs"), "r_name": F.max("num_cases")}
    tables = hierarchy.roll_up_with(
        customer_summary(t), ["r_name"], lambda level: {"leaves": F.count(F.lit(1)), "total": total[level]}
    )
    root = tables["root"].select(F.lit("root").alias("node_type"), F.lit(None).cast("string").alias("node"), "leaves", "total")
    region = tables["r_name"].select(F.lit("region").alias("node_type"), F.col("r_name").alias("node"), "leaves", "total")
    return root.unionByName(region)


# ------------------------------------------------------------------ hierarchy
SUPPLIER_PATHS = """(SELECT s_suppkey, r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


def supplier_paths(t: Tables) -> DataFrame:
    paths = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    paths = paths.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return paths.select("s_suppkey", "r_name", "n_name", "s_name")


@query(
    "agg_callback_children",
    f"""WITH n AS (SELECT r_name, n_name, count(*) AS leaves, sum(s_suppkey)::BIGINT AS total FROM {SUPPLIER_PATHS} GROUP BY ALL),
         r AS (SELECT r_name, sum(leaves)::BIGINT AS leaves, (max(total) - min(total))::BIGINT AS total, arg_max(n_name, lpad(leaves::VARCHAR, 12, '0') || n_name) AS busiest,
               count(*) AS children FROM n GROUP BY r_name)
       SELECT 'nation' AS node_type, n_name AS node, leaves, total, NULL AS busiest, NULL AS children FROM n
       UNION ALL SELECT 'region', r_name, leaves, total, busiest, children FROM r
       UNION ALL SELECT 'root', NULL, sum(leaves)::BIGINT, max(total), arg_max(r_name, lpad(leaves::VARCHAR, 12, '0') || r_name), count(*) FROM r""",
)
def agg_callback_children(t: Tables) -> DataFrame:
    """A region reports how far its nations lie apart, the root the widest region, and both their largest child."""
    first = lambda name: F.max_by(name, F.struct("leaves", name)).alias("busiest")
    children = {"busiest": None, "children": F.count(F.lit(1)), "leaves": F.sum("leaves")}
    results = {
        "r_name": children | {"total": F.max("total") - F.min("total"), "busiest": first("n_name")},
        None: children | {"total": F.max("total"), "busiest": first("r_name")},
    }
    leaves = {"leaves": F.count(F.lit(1)), "total": F.sum("s_suppkey")}
    tables = hierarchy.fold_up(supplier_paths(t), ["r_name", "n_name"], leaves, results.__getitem__)
    nothing = F.lit(None).cast("string")
    nation = tables["n_name"].select(F.lit("nation").alias("node_type"), F.col("n_name").alias("node"), "leaves", "total", nothing.alias("busiest"), F.lit(None).cast("bigint").alias("children"))
    region = tables["r_name"].select(F.lit("region").alias("node_type"), F.col("r_name").alias("node"), "leaves", "total", "busiest", "children")
    root = tables["root"].select(F.lit("root").alias("node_type"), nothing.alias("node"), "leaves", "total", "busiest", "children")
    return nation.unionByName(region).unionByName(root)


@query(
    "path_rows",
    f"""SELECT s_suppkey, r_name, n_name, CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS s_name,
        'reports/' || s_suppkey AS path, 'local' AS platform FROM {SUPPLIER_PATHS}""",
)
def path_rows(t: Tables) -> DataFrame:
    """Each supplier as a nested mapping document; one in ten hangs one level higher."""
    leaf = F.format_string('{"path":"reports/%d","platform":"local"}', "s_suppkey")
    below = F.when(F.col("s_suppkey") % 10 != 0, F.format_string('{"%s":%s}', F.col("s_name"), leaf)).otherwise(leaf)
    doc = F.format_string('{"%s":{"%s":%s}}', F.col("r_name"), F.col("n_name"), below)
    documents = supplier_paths(t).select("s_suppkey", doc.alias("doc"))
    paths = hierarchy.mapping_paths(documents, "doc", ["r_name", "n_name", "s_name"], ["s_suppkey"])
    return paths.withColumns({"path": F.col("leaf")["path"], "platform": F.col("leaf")["platform"]}).drop("leaf")


@query(
    "level_order",
    """SELECT kind, min(depth) AS depth FROM (SELECT 'region' AS kind, 0 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey
       JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 'nation', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
       UNION ALL SELECT 'supplier', 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY kind""",
)
def level_order(t: Tables) -> DataFrame:
    catalogue = (
        t("region").select(F.col("r_name").alias("node"), F.lit("region").alias("type"))
        .unionByName(t("nation").select(F.col("n_name").alias("node"), F.lit("nation").alias("type")))
        .unionByName(t("supplier").select(F.col("s_name").alias("node"), F.lit("supplier").alias("type")))
    )
    return hierarchy.level_order(supplier_paths(t), ["r_name", "n_name", "s_name"], catalogue, "node", "type")


@query(
    "path_strings",
    f"""SELECT *, r_name || '-' || n_name AS parent_path, r_name || '-' || n_name || '-' || s_name AS leaf_id, 3 AS depth
        FROM {SUPPLIER_PATHS}""",
)
def path_strings(t: Tables) -> DataFrame:
    return hierarchy.path_strings(supplier_paths(t), ["r_name", "n_name"], "s_name")


@query(
    "inner_nodes",
    f"""SELECT 1 AS depth, r_name AS node, '' AS parent, count(*) AS leaves FROM {SUPPLIER_PATHS} GROUP BY r_name
        UNION ALL SELECT 2, r_name || '-' || n_name, r_name, count(*) FROM {SUPPLIER_PATHS} GROUP BY r_name, n_name""",
)
def inner_nodes(t: Tables) -> DataFrame:
    return hierarchy.nodes_of(supplier_paths(t), ["r_name", "n_name"])


@query("permute_levels", f"SELECT DISTINCT n_name AS level_1, r_name AS level_2, s_name FROM {SUPPLIER_PATHS}")
def permute_levels(t: Tables) -> DataFrame:
    return hierarchy.permute_levels(supplier_paths(t), ["r_name", "n_name"], [1, 0, 2], "s_name")


@query(
    "catalog_upsert",
    """SELECT o_custkey AS machine, o_orderpriority AS use_case, 'reports/' || arg_max(o_orderkey, tm) AS path,
       coalesce(min(CASE WHEN old THEN 'known' END), arg_min(o_orderstatus, tm)) AS title
       FROM (SELECT *, o_orderkey % 5 = 0 AS old, (CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1000000000000 END) + o_orderkey AS tm
       FROM orders) GROUP BY o_custkey, o_orderpriority""",
)
def catalog_upsert(t: Tables) -> DataFrame:
    rows = t("orders").select(
        F.col("o_custkey").alias("machine"), F.col("o_orderpriority").alias("use_case"), F.col("o_orderkey").alias("at"),
        F.concat(F.lit("reports/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("title"),
    )
    current = rows.where("at % 5 = 0").withColumn("title", F.lit("known"))
    return hierarchy.upsert_catalogue(current, rows.where("at % 5 <> 0"), ["machine", "use_case"], "at", "path", "title")


# -------------------------------------------------------------------- metrics
# Events are the files: each one is written as a small csv, tsv, json or log text.


def event_files(t: Tables, template: str, *names: str) -> DataFrame:
    """``text`` is the template filled with the named event columns; ``amount`` is the value as text."""
    events = t("events").withColumn("amount", F.col("value").cast("string"))
    return events.select("event_id", "user_id", F.format_string(template, *names).alias("text"))


CSV_TEXT = "kind, amount,id\n%s,%s,%d\n\n none ,-1e-3,%d\n"


@query(
    "metrics_csv",
    """SELECT event_id, m.* FROM events, LATERAL (SELECT 'run_kind_0' AS name, NULL::DOUBLE AS value, event_type AS value_str,
       's' AS unit UNION ALL SELECT 'run_amount_0', value, NULL, 'EUR' UNION ALL SELECT 'run_id_0', event_id, NULL, 's'
       UNION ALL SELECT 'run_kind_1', NULL, 'none', 's' UNION ALL SELECT 'run_amount_1', -0.001, NULL, 'EUR'
       UNION ALL SELECT 'run_id_1', user_id, NULL, 's') m""",
)
def metrics_csv(t: Tables) -> DataFrame:
    files = event_files(t, CSV_TEXT, "event_type", "amount", "event_id", "user_id")
    return metrics.csv_metrics(files, "text", ["event_id"], "run", {"*": "s", "amount": "EUR"})


TSV_TEXT = "# user amount   id\n-1 0.5  7\n%d   %s\t%d\n%d 0 0"


@query(
    "metrics_tsv",
    """SELECT event_id, m.* FROM events, LATERAL (SELECT 'file_amount' AS name, value, NULL::VARCHAR AS value_str, 's' AS unit
       UNION ALL SELECT 'file_id', event_id, NULL, 's') m""",
)
def metrics_tsv(t: Tables) -> DataFrame:
    files = event_files(t, TSV_TEXT, "user_id", "amount", "event_id", "user_id")
    return metrics.tsv_metrics(files, "text", ["event_id"], F.col("user_id"), "file")


def event_lines(t: Tables, header: str, line: Column) -> str:
    """Files of some 20,000 lines, one for each event, under a header; more events make more files."""
    path = scratch_dir(t.spark, "metric-files")
    part = F.floor(F.col("event_id") / 20_000).alias("part")
    rows = t("events").withColumn("amount", F.col("value").cast("string")).select(part, F.col("event_id").alias("at"), line.alias("value"))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("at"), F.lit(header).alias("value"))
    lines = rows.union(heads).repartition("part").sortWithinPartitions("part", "at")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


def part_of_file() -> Column:
    return F.regexp_extract("file", r"part=(\d+)", 1)


@query(
    "metrics_csv_files",
    """SELECT part, m.* FROM (SELECT *, event_id // 20000 AS part, CASE WHEN count(*) OVER (PARTITION BY event_id // 20000) > 1
       THEN '_' || (row_number() OVER (PARTITION BY event_id // 20000 ORDER BY event_id) - 1) ELSE '' END AS i FROM events),
       LATERAL (SELECT 'kind' || i AS name, NULL::DOUBLE AS value, event_type AS value_str, 's' AS unit
       UNION ALL SELECT 'amount' || i, value, NULL, 'EUR' UNION ALL SELECT 'id' || i, event_id, NULL, 's') m""",
)
def metrics_csv_files(t: Tables) -> DataFrame:
    """Rows are numbered in their file, which several tasks may read."""
    path = event_lines(t, "kind, amount,id\n", F.format_string("%s,%s , %d", "event_type", "amount", "event_id"))
    found = metrics.csv_file_metrics(t.spark, path, units={"*": "s", "amount": "EUR"})
    return found.withColumn("file", part_of_file().cast("bigint")).withColumnRenamed("file", "part")


@query(
    "metrics_tsv_files",
    """SELECT part, m.* FROM (SELECT event_id // 20000 AS part, min(event_id) AS id, arg_min(value, event_id) AS amount
       FROM events WHERE event_id % 2 = 0 GROUP BY ALL), LATERAL (SELECT 'file_amount' AS name, amount AS value, NULL::VARCHAR AS value_str, 's' AS unit
       UNION ALL SELECT 'file_id', id, NULL, 's') m""",
)
def metrics_tsv_files(t: Tables) -> DataFrame:
    """The first row of every file whose first field is its number; rows of odd events have another."""
    first = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 20_000).cast("string")).otherwise("odd")
    line = F.concat_ws(" \t", first, F.col("amount"), F.col("event_id").cast("string"))
    found = metrics.tsv_file_metrics(t.spark, event_lines(t, "# part amount   id", line), part_of_file(), "file")
    return found.withColumn("file", part_of_file().cast("bigint")).withColumnRenamed("file", "part")


JSON_TEXT = '{"hardware":{"%s":{"mem":{"host":%s,"dev":"%d"}},"gpu":{"mem":{"host":1}}},"props":%s}'


@query(
    "metrics_json",
    """SELECT event_id, m.* FROM events, LATERAL (SELECT event_type || '.host' AS name, value, NULL::VARCHAR AS value_str, 's' AS unit
       UNION ALL SELECT event_type || '.dev', NULL, CAST(user_id AS VARCHAR), 's' UNION ALL SELECT 'gpu.host', 1, NULL, 's'
       UNION ALL SELECT event_type, value, NULL, 's' UNION ALL SELECT 'gpu', 1, NULL, 's'
       UNION ALL SELECT 'props.k', json_extract_string(props, '$.k')::DOUBLE, NULL, 's') m""",
)
def metrics_json(t: Tables) -> DataFrame:
    paths = ["hardware.*.mem.*", "hardware.*.mem.host", "props"]
    files = event_files(t, JSON_TEXT, "event_type", "amount", "user_id", "props")
    return metrics.json_metrics(files, "text", ["event_id"], paths)


LINK = r'<a href="(?P<link_name>[^"]*)">(?P<link_value>[^<]*)</a>'
NUMBER_SQL = r"regexp_full_match(v, '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?')"


@query(
    "metrics_regex",
    f"""SELECT page_id, 'links_' || trim(n) AS name, CASE WHEN {NUMBER_SQL} THEN v::DOUBLE END AS value,
        CASE WHEN NOT {NUMBER_SQL} THEN v END AS value_str, 's' AS unit FROM (SELECT page_id, n, arg_max(v, i) AS v FROM (SELECT page_id,
        unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS n,
        unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS v,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2), 1) AS i FROM pages) GROUP BY page_id, n)""",
)
def metrics_regex(t: Tables) -> DataFrame:
    """The last of several links to one address counts."""
    return metrics.regex_metrics(t("pages"), "html", ["page_id"], LINK, "link_value", "link_name", "links")


@query(
    "match_ordinal",
    """SELECT page_id, 'match_' || (unnest(range(len(m)))) AS name, unnest(m) AS value_str FROM
       (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS m FROM pages)""",
)
def match_ordinal(t: Tables) -> DataFrame:
    found = metrics.regex_metrics(t("pages"), "html", ["page_id"], "<li>(?P<item>.*?)</li>", "item")
    return found.select("page_id", "name", F.coalesce("value_str", F.col("value").cast("string")).alias("value_str"))


@query(
    "metric_units",
    "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'ms' WHEN 'view' THEN 'min' ELSE 's' END AS unit FROM events",
)
def metric_units(t: Tables) -> DataFrame:
    unit = metrics.metric_units(F.col("event_type"), {"*": "s", "click": "ms", "view": "min"})
    return t("events").select("event_id", "event_type", unit.alias("unit"))


@query(
    "metric_merge",
    """SELECT event_id, m.* FROM events, LATERAL (SELECT 'kind' AS name, NULL::DOUBLE AS value, event_type AS value_str, 's' AS unit
       UNION ALL SELECT 'amount', -value, NULL, 'b' UNION ALL SELECT 'id', user_id, NULL, 'b') m""",
)
def metric_merge(t: Tables) -> DataFrame:
    first = event_files(t, "kind,amount,id\n%s,%s,%d", "event_type", "amount", "event_id")
    second = event_files(t, "amount,id\n-%s,%d", "amount", "user_id")
    stages = [
        metrics.csv_metrics(first, "text", ["event_id"]),
        metrics.csv_metrics(second, "text", ["event_id"], units={"*": "b"}),
    ]
    return metrics.merge_stages(stages, ["event_id"])


BY_USER = """(SELECT user_id, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'view') AS v,
    max(value) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)"""


@query(
    "custom_vars",
    f"""SELECT user_id, m.* FROM {BY_USER}, LATERAL (SELECT 'total' AS name, round(c + v, 6) AS value, 's' AS unit
        UNION ALL SELECT 'low', CASE WHEN c + v IS NOT NULL AND e IS NOT NULL THEN least(c, v, e) END, 's'
        UNION ALL SELECT 'high', CASE WHEN c IS NOT NULL AND e IS NOT NULL THEN greatest(c, e) END, 'ms'
        UNION ALL SELECT 'mix', round(((c + v) + greatest(c, e) + e) / CASE WHEN c + e IS NOT NULL THEN 3 END, 6), 's') m""",
)
def custom_vars(t: Tables) -> DataFrame:
    measured = t("events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.max("value").alias("value"))
    variables = [
        CustomVariable("total", "sum", ("click", "view")),
        CustomVariable("low", "min", ("click", "view", "error")),
        CustomVariable("high", "max", ("click", "error"), "ms"),
        CustomVariable("mix", "mean", ("total", "high", "error")),
    ]
    made = metrics.custom_variables(measured, ["user_id"], variables, missing="null")
    return made.withColumn("value", F.round("value", 6))


@query(
    "log_checks",
    """SELECT *, success AND no_errors AS passed FROM (SELECT source, lang, bool_and(contains(text, '.') AND contains(text, 'e'))
       AS success, bool_and(NOT contains(text, '(c)') AND NOT contains(text, 'zz[')) AS no_errors FROM documents GROUP BY ALL)""",
)
def log_checks(t: Tables) -> DataFrame:
    return metrics.check_logs(t("documents"), "text", ["source", "lang"], [".", "e"], ["(c)", "zz["])


# ---------------------------------------------------------------------- grids


@query(
    "grid_cross",
    """SELECT s_suppkey, tasks, mesh, elements FROM supplier, (SELECT unnest([1, 2, 4]) AS tasks),
       (SELECT unnest(['M1', 'M2', 'M3']) AS mesh), (SELECT unnest([10000, 20000]) AS elements)""",
)
def grid_cross(t: Tables) -> DataFrame:
    parameters = [
        Parameter("tasks", grids.values([1, 2, 4])),
        Parameter("off", grids.values([1, 2]), active=False),
        Parameter("mesh", grids.values(["M1", "M2", "M3"])),
        Parameter("elements", grids.values([10000, 20000])),
    ]
    return grids.parameter_grid(t("supplier").select("s_suppkey"), parameters)


@query(
    "grid_pruned",
    """SELECT c_custkey, mesh, memory, balance FROM (SELECT c_custkey, c_acctbal AS balance FROM customer),
       (SELECT unnest(['M1', 'M2', 'M3']) AS mesh), (SELECT unnest([512, 1024, 2048]) AS memory)
       WHERE (mesh <> 'M1' OR memory IN (512)) AND (mesh <> 'M2' OR memory IN (1024) OR (memory = 2048 AND balance = 0))""",
)
def grid_pruned(t: Tables) -> DataFrame:
    conditions = {"M1": [{"memory": [512]}], "M2": [{"memory": [1024]}, {"memory": [2048], "balance": [0.0]}]}
    parameters = [
        Parameter("mesh", grids.values(["M1", "M2", "M3"]), conditions=conditions),
        Parameter("memory", grids.values([512, 1024, 2048])),
    ]
    return grids.parameter_grid(t("customer").selectExpr("c_custkey", "c_acctbal as balance"), parameters)


@query(
    "grid_zip",
    """SELECT p_partkey, i * 5.0::DOUBLE AS "geo.x", p_size * i / 2 AS "geo.y", ['a', 'b', 'c', 'd'][i + 1] AS "geo.z"
       FROM part, (SELECT unnest(range(3)) AS i)""",
)
def grid_zip(t: Tables) -> DataFrame:
    geo = grids.zipped(
        {"x": grids.value_range(0, 10, 5), "y": grids.linspace(0, F.col("p_size"), 3), "z": grids.values(["a", "b", "c", "d"])}
    )
    grid = grids.expand(t("part").select("p_partkey", "p_size"), [Parameter("geo", geo)])
    return grids.flatten_parameters(grid, ["geo"]).drop("p_size")


@query(
    "grid_zip_nested",
    """SELECT p_partkey, "run.n", m AS "run.mem.m", "unit" AS "run.mem.unit" FROM part, (SELECT unnest([1, 2]) AS "run.n",
       unnest([512, 1024]) AS m, unnest(['MB', 'MB']) AS "unit")""",
)
def grid_zip_nested(t: Tables) -> DataFrame:
    inner = grids.zipped({"m": grids.values([512, 1024, 2048]), "unit": grids.repeat("MB", 5)})
    run = grids.zipped({"n": grids.values([1, 2]), "mem": inner})
    grid = grids.expand(t("part").select("p_partkey"), [Parameter("run", run)])
    return grids.flatten_parameters(grids.flatten_parameters(grid, ["run"]), ["run.mem"])


@query(
    "grid_linspace",
    """SELECT p_partkey, round(CASE WHEN i = 0 THEN p_size ELSE p_size + i * (2.0 * p_size - p_size) / 4 END, 6)::DOUBLE AS load
       FROM part, (SELECT unnest(range(5)) AS i)""",
)
def grid_linspace(t: Tables) -> DataFrame:
    load = Parameter("load", grids.linspace(F.col("p_size"), F.col("p_size") * 2, 5))
    return grids.expand(t("part").select("p_partkey", "p_size"), [load]).select("p_partkey", F.round("load", 6).alias("load"))


@query(
    "grid_geomspace",
    """SELECT p_partkey, round(p_retailprice * pow(1000.0::DOUBLE / p_retailprice, i / 3), 6) AS load
       FROM part, (SELECT unnest(range(4)) AS i)""",
)
def grid_geomspace(t: Tables) -> DataFrame:
    load = Parameter("load", grids.geomspace(F.col("p_retailprice"), 1000, 4))
    return grids.expand(t("part").select("p_partkey", "p_retailprice"), [load]).select("p_partkey", F.round("load", 6).alias("load"))


@query(
    "grid_geometric",
    "SELECT p_partkey, p_size * pow(-1.0::DOUBLE, i) AS load FROM part, (SELECT unnest(range(5)) AS i)",
)
def grid_geometric(t: Tables) -> DataFrame:
    load = Parameter("load", grids.geometric(F.col("p_size"), -1, 5))
    return grids.expand(t("part").select("p_partkey", "p_size"), [load]).select("p_partkey", "load")


@query(
    "grid_range",
    """SELECT p_partkey, unnest(range(0, CAST(ceil((p_size + 3) / 3) AS BIGINT))) * 3.0::DOUBLE AS load FROM part""",
)
def grid_range(t: Tables) -> DataFrame:
    load = Parameter("load", grids.value_range(0, F.col("p_size"), 3))
    return grids.expand(t("part").select("p_partkey", "p_size"), [load]).select("p_partkey", "load")


@query(
    "grid_sequence",
    """SELECT n_nationkey, s.tasks AS "res.tasks", s.mode AS "res.mode" FROM nation,
       (SELECT unnest([{'tasks': 1, 'mode': 'a'}, {'tasks': 2, 'mode': 'b'}]) AS s), customer WHERE c_nationkey = n_nationkey""",
)
def grid_sequence(t: Tables) -> DataFrame:
    nodes = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey")
    res = Parameter("res", grids.values([{"tasks": 1, "mode": "a"}, {"tasks": 2, "mode": "b"}]))
    return grids.flatten_parameters(grids.expand(nodes, [res]), ["res"])


@query("grid_repeat", "SELECT s_suppkey, s_nationkey AS again FROM supplier, (SELECT unnest(range(3)))")
def grid_repeat(t: Tables) -> DataFrame:
    again = Parameter("again", grids.repeat(F.col("s_nationkey"), 3))
    return grids.expand(t("supplier").select("s_suppkey", "s_nationkey"), [again]).select("s_suppkey", "again")
