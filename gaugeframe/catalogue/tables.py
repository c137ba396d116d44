"""Filters, projections, grouping, pivots, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.catalogue.registry import Tables, query
from gaugeframe.functions.columns import choose_column
from gaugeframe.operators import aggregates, columns, filters, lookups, sets
from gaugeframe.operators.ordinals import group_ordinals

# Events without a value for one type, so that every filter meets null cells.
GAPS = "(SELECT event_id, CASE WHEN event_type <> 'signup' THEN event_type END AS kind, value FROM events)"


def gaps(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return t("events").select("event_id", kind.alias("kind"), "value")


def _register_filters() -> None:
    cases = {
        "flt_eq": (("kind", "==", "error"), "kind = 'error'"),
        "flt_ne": (("kind", "!=", "error"), "kind IS DISTINCT FROM 'error'"),
        "flt_gt": (("value", ">", 100.0), "value > 100.0"),
        "flt_lt": (("value", "<", 5.0), "value < 5.0"),
        "flt_ge": (("value", ">=", 100.0), "value >= 100.0"),
        "flt_le": (("value", "<=", 5.0), "value <= 5.0"),
        "flt_in": (("kind", "in", ["error", "view"]), "kind IN ('error', 'view')"),
        "flt_not_in": (("kind", "not in", ["error", "view"]), "NOT coalesce(kind IN ('error', 'view'), false)"),
    }
    for name, (condition, where) in cases.items():
        query(name, f"SELECT * FROM {GAPS} WHERE {where}")(
            lambda t, condition=condition: filters.filter_rows(gaps(t), [condition])
        )


_register_filters()


@query("flt_all", f"SELECT * FROM {GAPS} WHERE kind IS DISTINCT FROM 'view' AND value >= 20.0 AND value < 80.0")
def flt_all(t: Tables) -> DataFrame:
    return filters.filter_rows(gaps(t), [("kind", "!=", "view"), ("value", ">=", 20.0), ("value", "<", 80.0)])


@query("flt_text_step", "SELECT * FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7'")
def flt_text_step(t: Tables) -> DataFrame:
    return filters.filter_text(t("customer"), "c_nationkey", "filter:7")


@query(
    "axis_filter_relabel",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END
       AS o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def axis_filter_relabel(t: Tables) -> DataFrame:
    orders = t("orders").select("o_orderkey", "o_orderpriority")
    return filters.filter_and_relabel(orders, "o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high"})


LEAVES = """(SELECT CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment || '-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')
             AS leaf, c_acctbal FROM customer)"""


def customer_leaves(t: Tables) -> DataFrame:
    leaf = F.concat_ws("-", F.col("c_nationkey"), "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return t("customer").select(leaf.alias("leaf"), "c_acctbal")


@query(
    "select_leaves",
    f"""SELECT * FROM {LEAVES} WHERE split_part(leaf, '-', 2) = 'BUILDING'
        ORDER BY split_part(leaf, '-', 3) DESC, leaf DESC LIMIT 1""",
)
def select_leaves(t: Tables) -> DataFrame:
    return filters.select_leaves(customer_leaves(t), "leaf", ["all", "BUILDING", "latest"])


@query(
    "select_leaves_level",
    f"SELECT * FROM {LEAVES} WHERE split_part(leaf, '-', 1) = '3' AND split_part(leaf, '-', 2) = 'BUILDING'",
)
def select_leaves_level(t: Tables) -> DataFrame:
    return filters.select_leaves(customer_leaves(t), "leaf", ["3", "BUILDING", "all"])


@query(
    "computed_columns",
    """SELECT *, net * (1 + l_tax) AS charge FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) AS net FROM lineitem)""",
)
def computed_columns(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return columns.computed_columns(
        rows, {"net": "l_extendedprice * (1 - l_discount)", "charge": "net * (1 + l_tax)"}
    )


@query(
    "grade_column",
    """SELECT p_partkey, p_size, CASE WHEN p_size >= 40 THEN 'A' WHEN p_size >= 25 THEN 'B'
       WHEN p_size >= 10 THEN 'C' ELSE 'D' END AS grade FROM part""",
)
def grade_column(t: Tables) -> DataFrame:
    parts = t("part").select("p_partkey", "p_size")
    return columns.grade_column(parts, "grade", "p_size", [(40, "A"), (25, "B"), (10, "C")], "D")


@query("link_column", "SELECT o_orderkey, 'link:logs/' || o_orderkey || '.html[Logs]' AS logs_link FROM orders")
def link_column(t: Tables) -> DataFrame:
    return columns.link_column(t("orders").select("o_orderkey"), "logs_link", "o_orderkey", "logs/{}.html", "Logs")


@query("layout", "SELECT c_mktsegment AS segment, c_name AS customer, c_acctbal FROM customer")
def layout(t: Tables) -> DataFrame:
    order = ["c_mktsegment", "no_such_column", "c_name", "c_acctbal"]
    return columns.layout(t("customer"), order, {"c_mktsegment": "segment", "c_name": "customer"})


@query("first_column", "SELECT c_custkey, c_mktsegment AS chosen FROM customer")
def first_column(t: Tables) -> DataFrame:
    customers = t("customer")
    name = choose_column("segment|c_mktsegment|c_name", customers.columns)
    return customers.select("c_custkey", F.col(name).alias("chosen"))


@query(
    "prefix_columns",
    """SELECT s_suppkey AS "runs.s_suppkey", s_name AS "runs.s_name", s_nationkey AS "runs.s_nationkey",
       s_acctbal AS "runs.s_acctbal", 'suppliers' AS repository FROM supplier""",
)
def prefix_columns(t: Tables) -> DataFrame:
    return columns.attach_constant(columns.prefix_columns(t("supplier"), "runs."), "repository", "suppliers")


NESTED_EVENT = """'{"user":{"id":' || user_id || ',"tags":["' || event_type || '",{"v":' || event_id || '}],"none":{}},"props":' || props || '}'"""


@query(
    "flatten_json",
    f"""SELECT event_id, path, value FROM (
          SELECT event_id, replace(replace(substr(j.fullkey, 3), '[', '.'), ']', '') AS path, j.atom ->> '$' AS value
          FROM (SELECT event_id, {NESTED_EVENT} AS doc FROM events) e, json_tree(e.doc) j WHERE j.atom IS NOT NULL)""",
)
def flatten_json(t: Tables) -> DataFrame:
    doc = F.format_string(
        '{"user":{"id":%d,"tags":["%s",{"v":%d}],"none":{}},"props":%s}', "user_id", "event_type", "event_id", "props"
    )
    return columns.flatten_document(t("events").select("event_id", doc.alias("doc")), "doc", ["event_id"])


@query(
    "group_map",
    """SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, max(o_orderkey) AS o_orderkey
       FROM orders GROUP BY ALL""",
)
def group_map(t: Tables) -> DataFrame:
    grouped = aggregates.group_rows(
        t("orders"), ["o_orderstatus", "o_orderpriority"], {"o_totalprice": "sum", "o_orderkey": "max"}
    )
    return grouped.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "group_nulls",
    f"SELECT kind, count(value) AS value, max(event_id) AS event_id FROM {GAPS} WHERE kind IS NOT NULL GROUP BY kind",
)
def group_nulls(t: Tables) -> DataFrame:
    return aggregates.group_rows(gaps(t), ["kind"], {"value": "count", "event_id": "max"})


@query(
    "group_all",
    """SELECT l_returnflag, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_tax) AS l_tax
       FROM lineitem GROUP BY l_returnflag""",
)
def group_all(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    return aggregates.group_rows(rows, ["l_returnflag"], "max")


@query(
    "agg_functions",
    """SELECT user_id, round(sum(value), 4) AS f_sum, avg(event_id) AS f_mean, min(value) AS f_min,
       max(value) AS f_max, arg_min(kind, event_id) FILTER (kind IS NOT NULL) AS f_first, count(kind) AS f_count,
       count(DISTINCT kind) AS f_nunique, median(value) AS f_median, round(stddev_samp(value), 4) AS f_std,
       round(var_samp(value), 3) AS f_var, arg_max(kind, event_id) FILTER (kind IS NOT NULL) AS f_last,
       count(*) AS f_size, round(product(1 + value / 1e6), 6) AS f_prod
       FROM (SELECT *, CASE WHEN event_type <> 'signup' THEN event_type END AS kind FROM events) GROUP BY user_id""",
)
def agg_functions(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") != "signup", F.col("event_type"))
    named = {
        "f_sum": ("sum", "value"), "f_mean": ("mean", "event_id"), "f_min": ("min", "value"), "f_max": ("max", "value"),
        "f_first": ("first", "kind"), "f_count": ("count", "kind"), "f_nunique": ("nunique", "kind"),
        "f_median": ("median", "value"), "f_std": ("std", "value"), "f_var": ("var", "value"),
        "f_last": ("last", "kind"), "f_size": ("size", "value"), "f_prod": ("prod", "factor"),
    }
    rows = t("events").withColumn("kind", kind).withColumn("factor", 1 + F.col("value") / 1e6)
    rows = rows.select("user_id", "event_id", *[F.col(c).alias(name) for name, (_, c) in named.items()])
    grouped = aggregates.group_rows(rows, ["user_id"], {n: fn for n, (fn, _) in named.items()}, order_by="event_id")
    digits = {"f_sum": 4, "f_std": 4, "f_var": 3, "f_prod": 6}
    return grouped.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "pivot_table",
    """SELECT l_returnflag, max(l_extendedprice) FILTER (l_linestatus = 'F') AS "F",
       max(l_extendedprice) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def pivot_table(t: Tables) -> DataFrame:
    return aggregates.pivot_table(t("lineitem"), ["l_returnflag"], ["l_linestatus"], "l_extendedprice", "max", ["F", "O"])


FLAG_STATUS = [(flag, status) for flag in "ANR" for status in "FO"]


@query(
    "pivot_columns",
    "SELECT l_linenumber, "
    + ", ".join(f"""max(l_extendedprice) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}') AS "{a}_{b}\"""" for a, b in FLAG_STATUS)
    + " FROM lineitem GROUP BY l_linenumber",
)
def pivot_columns(t: Tables) -> DataFrame:
    return aggregates.pivot_table(t("lineitem"), ["l_linenumber"], ["l_returnflag", "l_linestatus"], "l_extendedprice", "max", FLAG_STATUS)


@query(
    "pivot_dense",
    """SELECT l_suppkey, l_quantity, nullif(count(l_tax) FILTER (l_linestatus = 'F'), 0) AS "F",
       nullif(count(l_tax) FILTER (l_linestatus = 'O'), 0) AS "O" FROM lineitem GROUP BY ALL""",
)
def pivot_dense(t: Tables) -> DataFrame:
    """Two index columns; the observed cells, not every combination of the levels."""
    return aggregates.pivot_table(
        t("lineitem"), ["l_suppkey", "l_quantity"], ["l_linestatus"], "l_tax", "count", ["F", "O"]
    )


@query(
    "group_median",
    """SELECT source, median(CASE WHEN source <> 'src1' THEN n_chars END) AS n_chars FROM documents GROUP BY source""",
)
def group_median(t: Tables) -> DataFrame:
    """A group that holds nulls only keeps its row."""
    rows = t("documents").select("source", F.when(F.col("source") != "src1", F.col("n_chars")).alias("n_chars"))
    return aggregates.group_rows(rows, ["source"], "median")


@query(
    "pivot_median",
    """SELECT l_linenumber, median(l_extendedprice) FILTER (l_linestatus = 'F') AS "F",
       median(l_extendedprice) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_linenumber""",
)
def pivot_median(t: Tables) -> DataFrame:
    return aggregates.pivot_table(t("lineitem"), ["l_linenumber"], ["l_linestatus"], "l_extendedprice", "median", ["F", "O"])


@query(
    "pivot_nulls",
    """SELECT CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS line, l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F",
       sum(l_quantity) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY ALL""",
)
def pivot_nulls(t: Tables) -> DataFrame:
    """Rows with a null index stay, also with two index columns."""
    line = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))
    rows = t("lineitem").withColumn("line", line)
    return aggregates.pivot_table(rows, ["line", "l_returnflag"], ["l_linestatus"], "l_quantity", "sum", ["F", "O"])


@query(
    "reduce_chain",
    """SELECT l_linenumber, l_returnflag, max(s) AS l_extendedprice FROM (SELECT l_linenumber, l_returnflag, l_quantity,
       round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY ALL""",
)
def reduce_chain(t: Tables) -> DataFrame:
    steps = [("l_linestatus", "filter:F"), ("no_such_column", "max"), ("l_suppkey", "sum"), ("l_quantity", "max")]
    reduced = aggregates.reduce_dimensions(t("lineitem"), ["l_linenumber", "l_returnflag"], "l_extendedprice", steps)
    return reduced.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query(
    "reduce_first",
    """SELECT o_orderstatus, o_orderpriority, arg_min(m, o_custkey) AS o_totalprice FROM (SELECT o_orderstatus,
       o_orderpriority, o_custkey, max(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY ALL""",
)
def reduce_first(t: Tables) -> DataFrame:
    steps = [("o_orderdate|ts", "max"), ("o_custkey", "first")]
    return aggregates.reduce_dimensions(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice", steps)


@query("axis_range", """SELECT event_type, min(value) - min(value) * 0.01 AS low, max(value) + min(value) * 0.01 AS high
       FROM events GROUP BY event_type""")
def axis_range(t: Tables) -> DataFrame:
    return aggregates.value_range(t("events"), "value", ["event_type"])


@query(
    "case_counts",
    """SELECT o_orderpriority, sum(len(string_split(o_orderpriority, '-'))) ::BIGINT AS num_items,
       count(*) AS num_cases, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS num_failures
       FROM orders GROUP BY o_orderpriority""",
)
def case_counts(t: Tables) -> DataFrame:
    orders = t("orders").select(
        "o_orderpriority",
        F.split("o_orderpriority", "-").alias("items"),
        F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("result"),
    )
    return aggregates.case_counts(orders, ["o_orderpriority"], "items", "result")


@query(
    "latest_leaf",
    """SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS o_orderkey,
       arg_max(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS o_orderstatus
       FROM orders GROUP BY o_custkey""",
)
def latest_leaf(t: Tables) -> DataFrame:
    return aggregates.latest_per_group(
        t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"]
    )


@query(
    "sort_nulls_last",
    f"SELECT *, row_number() OVER (ORDER BY kind DESC NULLS LAST, event_id) - 1 AS position FROM {GAPS}",
)
def sort_nulls_last(t: Tables) -> DataFrame:
    """The check ignores row order, so the place in the sorted output is kept as a column."""
    return aggregates.sorted_positions(gaps(t), [("kind", False), ("event_id", True)], "position")


@query(
    "union_missing",
    """SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS segment FROM nation
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def union_missing(t: Tables) -> DataFrame:
    return sets.union_rows(
        t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")),
        t("supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as acctbal"),
        t("customer").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as acctbal", "c_mktsegment as segment"),
    )


@query("ordered_distinct", "SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def ordered_distinct(t: Tables) -> DataFrame:
    return sets.ordered_distinct(t("documents").select("doc_id", "text", "lang"), ["text"], "doc_id")


@query(
    "except_defaults",
    """SELECT doc_id, lang, source, true AS is_default FROM documents WHERE lang = 'en' UNION ALL
       SELECT doc_id, lang, source, false FROM documents WHERE
       (doc_id, lang, source) NOT IN (SELECT doc_id, lang, source FROM documents WHERE lang = 'en')""",
)
def except_defaults(t: Tables) -> DataFrame:
    documents = t("documents")
    defaults = documents.where("lang = 'en'").select("doc_id", "lang", "source")
    own = documents.select("doc_id", "lang", "source")
    return sets.with_defaults(defaults, own, ["doc_id", "lang", "source"], "is_default")


@query(
    "deep_merge",
    """WITH p AS (
         SELECT user_id, event_id, 'type' AS path, event_type AS value FROM events
         UNION ALL SELECT user_id, event_id, 'props.k', json_extract_string(props, '$.k') FROM events
         UNION ALL SELECT user_id, event_id, 'seen', 'never' FROM events WHERE event_type = 'signup'
         UNION ALL SELECT user_id, event_id, 'seen.' || event_type, value::VARCHAR FROM events
           WHERE value >= 50 AND event_type <> 'signup'),
       r AS (SELECT *, event_id + CASE WHEN value IN ('', '0', '0.0', 'false') THEN 0 ELSE 1000000000000 END AS tm FROM p),
       m AS (SELECT user_id, path, arg_max(value, tm) AS value, max(tm) AS tm FROM r GROUP BY ALL)
       SELECT user_id, path, value FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.user_id = m.user_id AND o.tm > m.tm
         AND (starts_with(m.path, o.path || '.') OR starts_with(o.path, m.path || '.')))""",
)
def deep_merge(t: Tables) -> DataFrame:
    """The last writer of a path wins, but an empty value (here ``k`` = 0) never replaces another."""
    seen = F.when(F.col("event_type") == "signup", '"never"').when(
        F.col("value") >= 50, F.format_string('{"%s":"%s"}', "event_type", F.col("value").cast("string"))
    )
    doc = F.format_string(
        '{"type":"%s","props":%s,"seen":%s}', "event_type", "props", F.coalesce(seen, F.lit("{}"))
    )
    documents = t("events").select("user_id", "event_id", doc.alias("doc"))
    return sets.merge_documents(documents, "doc", ["user_id"], "event_id").where("kind = 'scalar'").select("user_id", "path", "value")


@query(
    "deep_merge_documents",
    """WITH e AS (SELECT user_id, event_id, event_type AS t, json_extract_string(props, '$.k') AS k FROM events),
       c AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
       items AS (SELECT user_id, event_id, 0 AS i, '{"k":' || k || ',"type":"' || t || '"}' AS value FROM e
         UNION ALL SELECT user_id, event_id, 1, '{"k":' || k || ',"type":"' || t || '"}' FROM e UNION ALL SELECT user_id, event_id, 2, t FROM e),
       firsts AS (SELECT * FROM (SELECT items.*, n, row_number() OVER (PARTITION BY items.user_id, value ORDER BY event_id, i) AS r
         FROM items JOIN c ON items.user_id = c.user_id) WHERE r = 1 OR n = 1)
       SELECT user_id, 'tags' AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id, i) - 1 AS position, value, 'list' AS kind FROM firsts
       UNION ALL SELECT user_id, 'flag', NULL, arg_max(CASE WHEN t = 'signup' THEN '7' ELSE '0' END, event_id), 'scalar' FROM e GROUP BY user_id
       UNION ALL SELECT user_id, 'in.void', NULL, CASE WHEN bool_or(t = 'signup') THEN '5' ELSE '0' END, 'scalar' FROM e GROUP BY user_id
       UNION ALL SELECT user_id, 'in.hollow', NULL, '{}', 'object' FROM e GROUP BY user_id
       UNION ALL SELECT user_id, 'list', NULL, '[]', 'list' FROM e GROUP BY user_id""",
)
def deep_merge_documents(t: Tables) -> DataFrame:
    """Lists of objects make one list whatever the order of keys; the text ``0`` replaces, the number, ``{}`` and ``[]`` don't."""
    signup = F.col("event_type") == "signup"
    k = F.get_json_object("props", "$.k")
    doc = F.format_string(
        '{"tags":[{"type":"%s","k":%s},{"k":%s,"type":"%s"},"%s"],"flag":%s,"in":{"void":%s,"hollow":{}},"list":[]}',
        "event_type", k, k, "event_type", "event_type", F.when(signup, "7").otherwise('"0"'), F.when(signup, "5").otherwise("0"),
    )
    return sets.merge_documents(t("events").select("user_id", "event_id", doc.alias("doc")), "doc", ["user_id"], "event_id")


@query(
    "deep_merge_lists",
    """SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_doc) - 1 AS position FROM
       (SELECT lang, source AS item, min(doc_id) AS first_doc FROM documents GROUP BY ALL)""",
)
def deep_merge_lists(t: Tables) -> DataFrame:
    items = t("documents").select("lang", F.col("source").alias("item"), "doc_id")
    return sets.merge_lists(items, ["lang"], "item", "doc_id").withColumnRenamed("doc_id", "first_doc")


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _brand_table(t: Tables) -> DataFrame:
    return aggregates.pivot_table(t("part"), ["p_brand"], ["p_type"], "p_retailprice", "min", PART_TYPES)


@query(
    "melt",
    f"""SELECT p_brand, series, min(p_retailprice) FILTER (p_type = series) AS value
        FROM part CROSS JOIN (SELECT unnest({PART_TYPES}) AS series) GROUP BY ALL""",
)
def melt(t: Tables) -> DataFrame:
    return sets.melt(_brand_table(t), ["p_brand"], PART_TYPES)


@query(
    "transpose",
    """SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F",
       max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (o_orderstatus = 'P') AS "P"
       FROM orders GROUP BY o_orderpriority""",
)
def transpose(t: Tables) -> DataFrame:
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    table = aggregates.pivot_table(t("orders"), ["o_orderstatus"], ["o_orderpriority"], "o_totalprice", "max", priorities)
    return sets.transpose(table, "o_orderstatus", ["F", "O", "P"], "o_orderpriority")


@query(
    "catalog_semi",
    """SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'AFRICA'))""",
)
def catalog_semi(t: Tables) -> DataFrame:
    mapping = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mapping = mapping.select("c_custkey", "c_nationkey", "n_regionkey")
    known = t("region").where(F.col("r_name").isin("ASIA", "AFRICA")).select(F.col("r_regionkey").alias("n_regionkey"))
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return lookups.known_nodes(mapping, {"n_regionkey": known, "c_nationkey": nations})


@query(
    "catalog_left",
    """SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON s_nationkey = n_nationkey""",
)
def catalog_left(t: Tables) -> DataFrame:
    metadata = t("nation").where("n_regionkey <> 0").selectExpr("n_nationkey as s_nationkey", "n_name")
    return lookups.node_metadata(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), metadata, ["s_nationkey"])


PARENTS = "(SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)"


@query("attach_leaves", f"SELECT c_custkey, c_nationkey FROM customer JOIN {PARENTS} ON c_nationkey = n_nationkey")
def attach_leaves(t: Tables) -> DataFrame:
    return lookups.attach_leaves(*_leaves_and_parents(t), ["c_nationkey"])


@query("orphans_anti", f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN {PARENTS}")
def orphans_anti(t: Tables) -> DataFrame:
    return lookups.orphan_leaves(*_leaves_and_parents(t), ["c_nationkey"])


def _leaves_and_parents(t: Tables) -> tuple[DataFrame, DataFrame]:
    parents = t("nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return t("customer").select("c_custkey", "c_nationkey"), parents


@query(
    "defaults_coalesce",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, n_name, 'any') AS template
       FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey""",
)
def defaults_coalesce(t: Tables) -> DataFrame:
    own = t("customer").select(
        "c_custkey", F.col("c_nationkey").alias("level"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("template")
    )
    level = t("nation").where("n_regionkey <> 0").selectExpr("n_nationkey as level", "n_name as template")
    return lookups.with_default(own, level, "level", "template", "any").select("c_custkey", "template")


@query(
    "multi_key_lookup",
    """SELECT s_suppkey, p.plots FROM supplier JOIN (SELECT unnest(string_split(k, '|')) AS id, plots FROM
       (SELECT n_nationkey || '|' || (n_nationkey + 25) AS k, n_name AS plots FROM nation)) p ON p.id = s_nationkey::VARCHAR""",
)
def multi_key_lookup(t: Tables) -> DataFrame:
    keyed = t("nation").select(
        F.concat_ws("|", F.col("n_nationkey"), F.col("n_nationkey") + 25).alias("key"), F.col("n_name").alias("plots")
    )
    nodes = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("id"))
    return lookups.multi_key_lookup(nodes, "id", keyed, "key").select("s_suppkey", "plots")
