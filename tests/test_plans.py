import json

import pytest
from pyspark.sql import functions as F

import gaugeframe.catalogue.all  # noqa: F401  (registers the queries)
from gaugeframe.catalogue.registry import QUERIES
from gaugeframe.operators.transforms import Axes
from gaugeframe.plans.fields import Field, Fields
from gaugeframe.plans.report import plugin_columns, read_request, report_data
from gaugeframe.plans.table_options import GroupBy, Pivot, TableOptions, apply_options
from gaugeframe.session import scratch_dir
from gaugeframe.sources import readers, sinks

TOURS = "tour,km,parcels,road\nnorth,12.5,40,open\nharbour,3.2,8,shut\nhill,7.75,31,open\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "tours.csv").write_text(TOURS)
    (base / "days.json").write_text(json.dumps([{"subject": s, "absent": a} for s, a in [("Music", 7), ("Music", 8), ("Sport", 9)]]))
    (base / "depot.json").write_text('{"depot": {"name": "D4"}, "vans": [2, 5, 9, 11]}')
    (base / "note.txt").write_text("two\nwords")
    return base


def test_formatted_field_is_text_for_its_references(spark, folder, rows):
    """The greatest text of 12 and 7 is 7: whoever refers to a formatted column gets texts, and the field below keeps its numbers."""
    fields = Fields(spark, map(Field.from_config, [
        {"name": "tours", "filepath": str(folder / "tours.csv")},
        {"name": "printed", "ref": "tours", "table_options": {
            "computed_columns": {"density": "parcels / km", "half": "density / 2"},
            "format": {"density": "%.1f", "km": "%i", "road": {"open": "yes"}}}},
        {"name": "by_road", "ref": "printed", "table_options": {
            "group_by": {"columns": ["road"], "agg": {"km": "max", "tour": "nunique"}}}},
    ]))
    printed = rows(fields.resolve("printed").select("tour", "density", "half", "km"))
    assert printed == [("harbour", "2.5", 1.25, "3"), ("hill", "4.0", 2.0, "7"), ("north", "3.2", 1.6, "12")]
    assert rows(fields.resolve("by_road")) == [("shut", "3", 1), ("yes", "7", 2)]
    assert rows(fields.resolve("tours"))[1] == ("hill", 7.75, 31, "open")


def test_group_sort_format(spark, folder):
    options = {"group_by": {"columns": ["subject"], "agg": "mean"}, "format": {"absent": "%.1f"},
               "sort": [{"column": "absent", "ascending": False}, {"column": "subject"}]}
    field = Field.from_config({"name": "d", "type": "DataTable", "filepath": str(folder / "days.json"), "table_options": options})
    assert [tuple(r) for r in Fields(spark, [field]).resolve("d").collect()] == [("Sport", "9.0"), ("Music", "7.5")]


def test_request_rules():
    with pytest.raises(ValueError):
        TableOptions(group_by=GroupBy(["a"], "sum"), pivot=Pivot(["a"], ["b"], "c", "sum"))
    with pytest.raises(ValueError):
        TableOptions(group_by=GroupBy(["a"], {}))
    with pytest.raises(ValueError):
        TableOptions(pivot=Pivot(["a"], ["b"], "c", "sum"), sort=[("a", True)])
    with pytest.raises(ValueError):
        TableOptions.from_config({"filter": [{"column": "a", "op": "like", "value": 1}]})
    with pytest.raises(ValueError):
        TableOptions.from_config({"limit": 3})


def test_references_chain_and_circles(spark, rows):
    plus, times = (lambda df: df.withColumn("x", F.col("x") + 1)), (lambda df: df.withColumn("x", F.col("x") * 2))
    one = Field.from_config({"name": "a", "columns": [{"name": "x", "values": [1]}], "preprocessor": plus})
    two = Field.from_config({"name": "b", "ref": "a", "preprocessor": times})
    fields = Fields(spark, [one, two])
    assert rows(fields.resolve("b")) == [(4,)] and rows(fields.resolve("a")) == [(2,)]
    circle = Fields(spark, [Field("a", "ref", "b"), Field("b", "ref", "a")])
    with pytest.raises(ValueError, match="a -> b -> a"):
        circle.resolve("a")
    with pytest.raises(KeyError):
        fields.resolve("zz")
    with pytest.raises(ValueError):
        Fields(spark, [Field("t", "value", "text", kind="DataTable")]).resolve("t")


def test_inline_tables(spark, rows):
    table = readers.inline_table(spark, [{"name": "a", "values": [1, 2.5]}, {"name": "b", "values": ["1", 2], "dtype": "int"}])
    assert rows(table) == [(1.0, 1), (2.5, 2)]
    with pytest.raises(ValueError, match="same length"):
        readers.inline_table(spark, [{"name": "a", "values": [1]}, {"name": "b", "values": []}])
    with pytest.raises(ValueError):
        readers.inline_table(spark, [{"name": "a", "values": [1], "dtype": "file"}])


def test_suffixes():
    assert [readers.format_of(p) for p in ("x/a.csv", "a.JSON", "a.txt")] == ["csv", "json", "raw"]
    with pytest.warns(UserWarning):
        assert readers.format_of("a.xyz") == "raw"


def test_whole_report_request(spark, folder):
    request = '''{ // comments and a comma too many
      "data": [
        {"name": "tours", "filepath": "%(f)s/tours.csv"}, {"name": "base", "filepath": "%(f)s/depot.json"},
        {"name": "memo", "filepath": "%(f)s/note.txt", "preprocessor": "strip_newlines"}, ],
      "contents": [
        {"type": "text", "ref": "base", "text": "@{vans | length}@ vans at @{depot.name}@"},
        {"type": "section", "contents": [
          {"type": "plot", "ref": "tours", "plot": {"title": "Loads", "plot_types": ["scatter"], "transformation": "speedup",
            "xaxis": {"parameter": "km"}, "color_axis": {"parameter": "road"}, "yaxis": {"parameter": "parcels"}}},
          {"type": "table", "ref": "tours", "layout": {"rename": {"road": "Road"}, "column_order": ["road", "absent", "tour"]}}]},
        {"type": "text", "ref": "memo", "text": "<@{memo}@>" } ] }''' % {"f": folder}
    (folder / "request.json").write_text(request)
    _, shown = report_data(spark, read_request(spark, str(folder / "request.json")))
    assert [kind for kind, _, _ in shown] == ["text", "scatter", "table", "text"]
    assert shown[0][2].first().text == "4 vans at D4" and shown[3][2].first().text == "<two words>"
    assert shown[1][2].where("is_guide").count() == 2 * 3  # two guide lines at each distance
    assert shown[2][2].columns == ["Road", "tour"]


def test_plugins_in_order(spark):
    df = plugin_columns(spark.range(1), [lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("a", F.col("a") + 1)])
    assert df.first().a == 2


def test_pivot_levels_are_looked_up(spark, rows):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "i string, c string, v int")
    assert apply_options(df, TableOptions(pivot=Pivot(["i"], ["c"], "v", "sum"))).columns == ["i", "x", "y"]


def test_chart_traces_have_one_shape(spark):
    df = spark.range(25).selectExpr("id as x", "'hot' as perfvalue", "id * 1.5 as value")
    traces = sinks.chart_traces(df, Axes(x="x")).orderBy("position").collect()
    assert [tuple(t)[1:] for t in traces] == [(i, i, i * 1.5) for i in range(25)]


def test_table_object_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(2, None, 1.5), (1, 'a"}', None), (3, "c", 2.0)], "at int, v string, n double")
    got = readers.table_to_object(df, "at").orderBy("column", "position").collect()
    assert [(r.column, r.position, json.loads(r.value)) for r in got] == [
        ("n", 0, None), ("n", 1, 1.5), ("n", 2, 2.0), ("v", 0, 'a"}'), ("v", 1, None), ("v", 2, "c"),
    ]


def test_shared_fields_are_worked_out_once(spark, folder, rows):
    """Two sorted views, a plain alias and a preprocessed copy of one file: the file is read once, each sink reads what is stored."""
    seen = []

    def noted(df):
        seen.append(df)
        return df.withColumn("km", F.col("km") * 2)

    by = lambda c: {"sort": [{"column": c}]}
    request = {
        "data": [
            {"name": "tours", "filepath": str(folder / "tours.csv"), "preprocessor": noted},
            {"name": "near", "ref": "tours", "table_options": by("km")},
            {"name": "alias", "ref": "tours"},
            {"name": "open", "ref": "alias", "table_options": {"filter": [{"column": "road", "op": "==", "value": "open"}]}},
            {"name": "unused", "filepath": str(folder / "missing.csv")},
            {"name": "once", "filepath": str(folder / "tours.csv")},
        ],
        "contents": [
            {"type": "table", "ref": "near"},
            {"type": "section", "contents": [{"type": "table", "ref": "alias"}, {"type": "table", "ref": "open"}, {"type": "table", "ref": "open"}]},
            {"type": "table", "ref": "once"},
        ],
    }
    fields, shown = report_data(spark, request)
    assert dict(fields.readings) == {"tours": 3, "near": 1, "alias": 2, "open": 2, "unused": 0, "once": 1}
    assert all("tours.csv" not in f for _, _, df in shown[:4] for f in df.inputFiles()) and len(seen) == 1
    assert shown[4][2].inputFiles()[0].endswith("tours.csv")
    assert [r.tour for r in shown[0][2].collect()] == ["harbour", "hill", "north"]
    assert rows(shown[1][2]) == rows(noted(readers.read_csv(spark, str(folder / "tours.csv"))))
    assert rows(shown[2][2].select("tour", "km")) == [("hill", 15.5), ("north", 25.0)]


def test_log_pages(spark, tmp_path, rows):
    cases = spark.createDataFrame([("a",), ("b",)], "case string")
    logs = spark.createDataFrame(
        [("a", "script", "run"), ("a", "output_log", "ok"), ("a", "error_log", ""), ("a", "my.log", "mine"), ("b", "my.log", "hidden"), ("z", "script", "no")],
        "case string, kind string, text string",
    )
    sections = sinks.log_sections(cases, logs, "case")
    got = {k: [r.kind for r in sections.where(f"case = '{k}'").orderBy("rank").collect()] for k in ("a", "b", "z")}
    assert got == {"a": ["head", "script", "output_log", "my.log"], "b": ["head"], "z": []}
    path = str(tmp_path / "pages")
    sinks.write_log_pages(sections, "case", path)
    (page,) = (tmp_path / "pages" / "pages").rglob("*.txt")
    text = page.read_text()
    places = [text.index(t) for t in ("= Logs", "== Scheduler script", "== Output log", "== my.log")]
    assert places == sorted(places) and text.count("= Logs") == 2
    assert rows(sinks.read_log_pages(spark, path)) == rows(sections.select("case", "rank", "kind", "value"))


def test_packed_log_pages(spark, tmp_path, rows):
    """Files follow the bytes, a long page goes on in the next file, and the index cuts every section out of them."""
    texts = [(i % 70, 1 + i % 3, f"k{i % 5}", "é" * (i % 11) + f"line {i % 35}\nend\n" * (i % 4)) for i in range(900)]
    texts += [(None, 1, "k", "no case"), (7, 4, "k", None), (7, 4, "k", ""), (8, 4, "k", "x" * 3000), (8, 4, "k", "x" * 3000)]
    sections = spark.createDataFrame(texts, "case int, rank int, kind string, value string").repartition(5)
    path = str(tmp_path / "packed")
    sinks.write_log_pages(sections, "case", path, file_bytes=1000)
    read = sinks.read_log_pages(spark, path)
    assert rows(read) == sorted([(c, r, k, v or "") for c, r, k, v in texts], key=repr)
    files = list((tmp_path / "packed" / "pages").rglob("*.txt"))
    total = sum(len((v or "").encode()) + 1 for *_, v in texts)
    assert sum(f.stat().st_size for f in files) == total and len(files) <= total / 1000 + 1
    assert max(f.stat().st_size for f in files) <= 1000 + 3001
    one = sinks.read_log_pages(spark, path, F.col("case") == 8)
    assert rows(one) == sorted([t for t in texts if t[0] == 8], key=repr)
    sinks.write_log_pages(sections.limit(0), "case", path)
    assert sinks.read_log_pages(spark, path).count() == 0


def test_scratch_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.startswith(base) if base else "gaugeframe" in path
    assert path != scratch_dir(spark, "x")


def test_many_json_documents_share_a_file(spark, tmp_path, rows):
    """The number of files follows the bytes and not the documents; a customer without a key has no document."""
    orders = [(i, i % 200 * 10**6 if i % 7 else None) for i in range(1000)] + [(None, 5)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["src_json_documents"](spark, str(tmp_path))
    assert len(got.inputFiles()) == 1
    want = {}
    for key, customer in orders:
        if customer is not None:
            want.setdefault(customer, []).extend([] if key is None else [key])
    assert rows(got) == rows(spark.createDataFrame([(c, len(k), sum(k)) for c, k in want.items()], "c bigint, n bigint, k bigint"))


def test_json_lists(spark, tmp_path):
    documents = spark.range(50).selectExpr("id", """concat('{\n "a": ', id, '\n}') AS doc""")
    sinks.write_json_lists(documents, "id", "doc", str(tmp_path / "lists"), 4)
    read = readers.read_json(spark, str(tmp_path / "lists"), "a BIGINT")
    assert sorted(r.a for r in read.collect()) == list(range(50))
    assert len(read.inputFiles()) == 4
    sinks.write_json_lists(documents.limit(0), "id", "doc", str(tmp_path / "none"), 4)
    assert readers.read_json(spark, str(tmp_path / "none"), "a BIGINT").count() == 0
