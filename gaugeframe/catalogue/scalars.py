"""Scalar functions and text at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.catalogue.registry import Tables, query
from gaugeframe.functions import scalars, text
from gaugeframe.functions.columns import python_text
from gaugeframe.operators.columns import flatten_document
from gaugeframe.operators.metrics import number_or_text
from gaugeframe.operators.runs import status_icon


@query(
    "fmt_printf",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate::VARCHAR AS l_shipdate, printf('%.1f', l_tax) AS l_tax,
       printf('%.2f EUR', l_extendedprice) AS l_extendedprice, printf('%d', l_quantity::BIGINT) AS l_quantity,
       printf('%.0f%%', l_discount * 100) AS l_discount FROM lineitem""",
)
def fmt_printf(t: Tables) -> DataFrame:
    rows = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("l_shipdate"), "l_tax",
        "l_extendedprice", "l_quantity", (F.col("l_discount") * 100).alias("l_discount"),
    )
    formats = {"l_tax": "%.1f", "l_extendedprice": "%.2f EUR", "l_quantity": "%i", "l_discount": "%.0f%%", "none": "%d"}
    return scalars.format_columns(rows, formats)


@query(
    "fmt_exact_ties",
    "SELECT p_partkey, printf('%.2f', p_retailprice / 8) AS eighth, printf('%.1f', p_size / 4.0::DOUBLE) AS quarter FROM part",
)
def fmt_exact_ties(t: Tables) -> DataFrame:
    """Halves of the last digit: exact ones go to the even digit, the others by their binary value."""
    return t("part").select(
        "p_partkey",
        scalars.fixed(F.col("p_retailprice") / 8, 2).alias("eighth"),
        scalars.fixed(F.col("p_size") / 4, 1).alias("quarter"),
    )


@query(
    "value_map",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '🟢' WHEN 'O' THEN '🟠' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'False' END AS is_high,
       CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 1 THEN 'one' WHEN 0 THEN '0.0' ELSE '2.0' END AS third FROM orders""",
)
def value_map(t: Tables) -> DataFrame:
    """Keys are Python texts: ``True`` for a flag, ``1.0`` for a double."""
    rows = t("orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") > 200000).alias("is_high"),
        (F.col("o_orderkey") % 3).cast("double").alias("third"),
    )
    maps = {"o_orderstatus": {"F": "🟢", "O": "🟠"}, "is_high": {"True": "high"}, "third": {"1.0": "one"}}
    return scalars.format_columns(rows, maps)


@query("python_text", "SELECT c_custkey, CAST(c_acctbal * 1000000 AS VARCHAR) AS shown FROM customer")
def python_text_query(t: Tables) -> DataFrame:
    """Doubles as Python prints them, large ones without an exponent."""
    shown = python_text(F.col("c_acctbal") * 1000000, T.DoubleType())
    return t("customer").select("c_custkey", shown.alias("shown"))


@query(
    "sanitize",
    "SELECT url, regexp_replace(replace(url, ' ', '-'), '[^\\p{L}\\p{N}_.\\-]', '', 'g') AS name FROM pages",
)
def sanitize(t: Tables) -> DataFrame:
    return t("pages").select("url", scalars.sanitize(F.col("url")).alias("name"))


@query(
    "title_label",
    """SELECT url, list_reduce(list_transform(regexp_extract_all(url, '\\p{L}+|[^\\p{L}]+'),
       lambda x: upper(x[1]) || lower(x[2:])), lambda a, b: a || b) AS label FROM pages""",
)
def title_label(t: Tables) -> DataFrame:
    return t("pages").select("url", scalars.title_label(F.col("url")).alias("label"))


@query(
    "split_expand",
    """SELECT c_name, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, NULL::VARCHAR AS missing FROM customer""",
)
def split_expand(t: Tables) -> DataFrame:
    part = lambda i, name: scalars.split_part(F.col("c_name"), "#", i).alias(name)
    return t("customer").select("c_name", part(0, "kind"), part(1, "number"), part(2, "missing"))


@query(
    "parse_leaf_date",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
)
def parse_leaf_date(t: Tables) -> DataFrame:
    folder = F.date_format("ts", "yyyy_MM_dd'T'HH_mm_ss")
    name = F.when(F.col("event_type") == "error", "draft").otherwise(folder)
    return t("events").select("event_id", scalars.leaf_date(name).cast("string").alias("at"))


@query(
    "duration_seconds",
    """SELECT o_orderkey, CASE WHEN h < 24 AND m < 60 THEN ((d * 24 + h) * 60 + m) * 60 + s END AS seconds FROM
       (SELECT o_orderkey, o_orderkey % 5 AS d, o_orderkey % 26 AS h, o_orderkey % 61 AS m, o_orderkey % 60 AS s FROM orders)""",
)
def duration_seconds(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    duration = F.format_string("%d-%d:%02d:%02d", key % 5, key % 26, key % 61, key % 60)
    return t("orders").select("o_orderkey", scalars.duration_seconds(duration).alias("seconds"))


FILLED = """SELECT event_id, event_type || ' by ' || user_id || ' k=' || json_extract_string(props, '$.k') || ' 2nd=' || value
       || ' n=2 @{no.path}@ ' || length(event_type) || '.' AS filled FROM events"""
TEMPLATE = "@{type}@ by @{user.id}@ k=@{props.k}@ 2nd=@{list.1}@ n=@{list | length}@ @{no.path}@ @{type|length}@."


def event_documents(t: Tables) -> DataFrame:
    doc = F.format_string(
        '{"type":"%s","user":{"id":%d},"props":%s,"list":["a",%s]}', "event_type", "user_id", "props", F.col("value").cast("string")
    )
    return t("events").select("event_id", F.parse_json(doc).alias("data"))


@query("fill_text", FILLED)
def fill_text(t: Tables) -> DataFrame:
    return event_documents(t).select("event_id", text.fill_text(TEMPLATE, F.col("data")).alias("filled"))


@query(
    "fill_text_column",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'user ' || user_id ELSE event_type || ' @{none}@' END AS filled FROM events""",
)
def fill_text_column(t: Tables) -> DataFrame:
    """Texts that differ by row."""
    written = F.when(F.col("event_id") % 2 == 0, "user @{user.id}@").otherwise("@{type}@ @{none}@")
    return event_documents(t).select("event_id", text.fill_text(written, F.col("data")).alias("filled"))


CHAIN = 14  # names that lead from one to the next


@query(
    "fill_config",
    """SELECT event_id, 'run ' || event_type || ' for ' || user_id || ' on {{unknown}} of ' || event_type || '/' || user_id
       || ' end ' || event_type || ' round {{here}} and {{there}}' AS target FROM events""",
)
def fill_config(t: Tables) -> DataFrame:
    """Names built from values, a long chain of names, and a circle whose names stay as written."""
    links = ",".join(f'"c{i}":"{{{{c{i + 1}}}}}"' for i in range(CHAIN))
    doc = F.format_string(
        '{"type":"%s","user":%d,"paths":{"%s":"{{type}}/{{user}}"},"here":"{{there}}","there":"{{here}}",' + links + f',"c{CHAIN}":"%s"}}',
        "event_type", "user_id", "event_type", "event_type",
    )
    flat = flatten_document(t("events").select("event_id", doc.alias("doc")), "doc", ["event_id"])
    written = "run {{type}} for {{ user }} on {{unknown}} of {{paths.{{type}}}} end {{c0}} round {{here}} and {{there}}"
    texts = text.path_map(flat, ["event_id"]).withColumn("target", F.lit(written))
    return text.fill_config(texts, "target", "lookup").select("event_id", "target")


@query(
    "markup_to_latex",
    r"""SELECT c_custkey, '50\% of \textbf{' || c_name || '} is $x^' || c_custkey || '$ at \href{https://h.org/' || c_custkey || '}{'
        || c_mktsegment || '}, \url{mailto:a@b.c} \hyperlink{s' || c_custkey || '}{' || c_mktsegment || '} \ref{t' || c_custkey || '} a*b*c'
        AS latex FROM customer""",
)
def markup_to_latex(t: Tables) -> DataFrame:
    markup = F.format_string(
        "50%% of *%s* is stem:[ x^%d ] at https://h.org/%d[ %s ], mailto:a@b.c[] <<s%d, %s>> <<t%d>> a*b*c",
        "c_name", "c_custkey", "c_custkey", "c_mktsegment", "c_custkey", "c_mktsegment", "c_custkey",
    )
    return t("customer").select("c_custkey", text.markup_to_latex(markup).alias("latex"))


def _escape_sql(column: str) -> str:
    for char, escaped in text.LATEX_ESCAPES:
        column = f"replace({column}, '{char}', '{escaped}')"
    return column


@query("latex_escape", f"SELECT doc_id, {_escape_sql('text')} AS cell FROM documents")
def latex_escape(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.latex_escape(F.col("text")).alias("cell"))


@query("strip_quotes", "SELECT event_id, trim('\"\"' || event_type || '\" \"', '\"') AS name FROM events")
def strip_quotes(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('""'), "event_type", F.lit('" "'))
    return t("events").select("event_id", scalars.strip_quotes(quoted).alias("name"))


@query(
    "number_or_string",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS number,
       CASE WHEN event_type = 'view' THEN value || 'd' END AS words FROM events""",
)
def number_or_string(t: Tables) -> DataFrame:
    """``1.5d`` is no number, although a plain cast would read it as one."""
    shown = F.concat(F.col("value").cast("string"), F.when(F.col("event_type") == "view", "d").otherwise(""))
    number, words = number_or_text(shown)
    return t("events").select("event_id", number.alias("number"), words.alias("words"))


@query("status_icon", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '🟢' ELSE '🔴' END AS icon FROM orders")
def status_icon_query(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", status_icon(F.col("o_orderstatus") == "F").alias("icon"))


@query(
    "text_prep",
    """SELECT doc_id, upper(lang) AS lang, trim(replace(text, chr(10), ' '), ' ') AS line, array_to_string(list_transform(
       list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), ' ') AS words FROM documents""",
)
def text_prep(t: Tables) -> DataFrame:
    return t("documents").select(
        "doc_id",
        scalars.upper_case(F.col("lang")).alias("lang"),
        scalars.strip_newlines(F.col("text")).alias("line"),
        scalars.capitalise_words(F.col("text")).alias("words"),
    )
