import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import aggregates, columns, filters, sets
from gaugeframe.functions.columns import choose_column
from gaugeframe.functions.scalars import format_columns


@pytest.fixture(scope="module")
def students(spark):
    scores = {
        "Math": [("Alice", 85, True), ("Bob", 78, True), ("Charlie", 62, True)],
        "Physics": [("Alice", 92, True), ("Bob", 88, True), ("Charlie", 55, False)],
        "Chemistry": [("Alice", 70, True), ("Bob", 65, True), ("Charlie", 45, False)],
    }
    data = [(n, subject, score, ok) for subject, cells in scores.items() for n, score, ok in cells]
    return spark.createDataFrame(data, "name string, subject string, score bigint, passed boolean")


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, None)], "a int, b string")


def test_grades_and_formats(students):
    graded = columns.grade_column(students, "grade", "score", [(90, "A"), (80, "B"), (70, "C")], "D")
    shown = format_columns(graded, {"score": "%.1f", "passed": {"True": "yes", "False": "no"}})
    got = {(r.name, r.subject): (r.score, r.grade, r.passed) for r in shown.collect()}
    assert got["Alice", "Math"] == ("85.0", "B", "yes")
    assert got["Bob", "Math"] == ("78.0", "C", "yes")
    assert got["Charlie", "Physics"] == ("55.0", "D", "no")


@pytest.mark.parametrize(
    "condition, kept",
    [
        (("b", "==", "x"), [1, 3]), (("b", "!=", "x"), [2, 4, 5]), (("b", "in", ["x"]), [1, 3]),
        (("b", "in", [None, "x"]), [1, 3, 5]), (("b", "not in", ["x"]), [2, 4, 5]), (("b", "==", None), []),
        (("b", "!=", None), [1, 2, 3, 4, 5]), (("a", ">", 3), [4, 5]), (("a", "<=", 2), [1, 2]),
    ],
)
def test_conditions_follow_null_rules(small, condition, kept):
    assert sorted(r.a for r in filters.filter_rows(small, [condition]).collect()) == kept


def test_conjunction_and_unknown_operator(small):
    assert [r.a for r in filters.filter_rows(small, [("a", ">", 2), ("b", "==", "y")]).collect()] == [4]
    with pytest.raises(ValueError):
        filters.filter_rows(small, [("a", "~", 1)])
    with pytest.raises(ValueError):
        filters.filter_rows(small, [("zz", "==", 1)])


def test_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as v", "id as unused").write.parquet(str(tmp_path / "p"))
    df = filters.filter_rows(spark.read.parquet(str(tmp_path / "p")), [("id", ">", 50), ("id", "<", 60)]).select("v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "LessThan(id,60)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_relabel_and_text_step(small, rows):
    assert rows(filters.filter_and_relabel(small, "b", {"x": "ex"})) == [(1, "ex"), (3, "ex")]
    assert filters.filter_and_relabel(small, "b", {}).count() == 5
    assert rows(filters.filter_text(small.withColumn("f", F.col("a") > 4), "f", "filter:a:True")) == [(5, None, True)]
    assert rows(filters.filter_text(small.selectExpr("cast(a as double) a"), "a", "filter:2.0")) == [(2.0,)]


def test_choose_column():
    assert choose_column("p|q|r", ["r", "q"]) == "q"
    assert choose_column("", ["r"]) is None and choose_column("z", ["r"]) is None


def test_group_sums_and_null_keys(spark, rows):
    data = [("x", 1, 10), ("x", 2, 20), ("y", 3, 30), ("y", 4, 40), (None, 9, 9)]
    df = spark.createDataFrame(data, "grp string, val1 int, val2 int")
    assert rows(aggregates.group_rows(df, ["grp"], "sum")) == [("x", 3, 30), ("y", 7, 70)]
    nothing = df.withColumn("val1", F.lit(None).cast("int"))
    assert rows(aggregates.group_rows(nothing, ["grp"], {"val1": "sum", "val2": "count"})) == [("x", 0, 2), ("y", 0, 2)]
    with pytest.raises(ValueError):
        aggregates.group_rows(df, ["grp"], {"val1": "mode"})


def test_median_of_even_odd_and_null(spark, rows):
    data = [("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 4.0), ("b", 1.0), ("b", None), ("c", None), ("d", 5.0), ("d", 5.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = rows(aggregates.group_rows(df, ["k"], {"v": "median"}))
    assert got == [("a", 2.0), ("b", 2.5), ("c", None), ("d", 5.0)]
    both = rows(aggregates.group_rows(df, ["k"], {"v": "median"} | {}))
    assert both == got


def test_pivot(spark, rows):
    data = [("A", "m1", 10), ("A", "m2", 20), ("B", "m1", 30), ("B", "m2", 40)]
    df = spark.createDataFrame(data, "team string, metric string, value int")
    assert rows(aggregates.pivot_table(df, ["team"], ["metric"], "value", "mean", ["m1", "m2"])) == [("A", 10.0, 20.0), ("B", 30.0, 40.0)]


def test_pivot_keeps_null_index_rows_and_levels_apart(spark, rows):
    df = spark.createDataFrame([("a", 1, "p", 5), (None, 2, "p", 6), (None, None, "p", 7), ("a", 1, None, 9)], "i string, j int, c string, v int")
    assert rows(aggregates.pivot_table(df, ["i", "j"], ["c"], "v", "sum", ["p"])) == [("a", 1, 5), (None, 2, 6), (None, None, 7)]
    two = spark.createDataFrame([("k", "a_b", "c", 1), ("k", "a", "b_c", 5)], "k string, x string, y string, v int")
    got = aggregates.pivot_table(two, ["k"], ["x", "y"], "v", "sum", [("a_b", "c"), ("a", "b_c")])
    assert tuple(got.first()) == ("k", 1, 5) and got.columns == ["k", "a_b_c", "a_b_c"]


def test_unlisted_levels_fail(spark):
    df = spark.createDataFrame([("r", "x", 1), ("r", "y", 2), ("r", "z", 3)], "i string, s string, v int")
    with pytest.raises(Exception, match="not among the listed levels: z"):
        aggregates.spread(df, ["i"], "s", "v", ["x", "y"]).collect()
    with pytest.raises(Exception, match="not listed"):
        aggregates.pivot_table(df, ["i"], ["s"], "v", "sum", ["x", "y"]).collect()


def test_medians_keep_groups_of_nulls(spark, rows):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 4.0), ("b", "p", None), ("b", "q", None)], "k string, c string, v double")
    assert rows(aggregates.group_rows(df.drop("c"), ["k"], "median")) == [("a", 2.5), ("b", None)]
    assert rows(aggregates.pivot_table(df, ["k"], ["c"], "v", "median", ["p", "q"])) == [("a", 2.5, None), ("b", None, None)]


def test_strict_spread_fails_on_a_second_row(spark):
    df = spark.createDataFrame([("a", "s", 1), ("a", "s", 2)], "i string, s string, v int")
    with pytest.raises(Exception, match="several rows"):
        aggregates.spread(df, ["i"], "s", "v", ["s"], strict=True).collect()


def test_sort_puts_nulls_last_both_ways(small):
    assert [r.a for r in aggregates.sort_rows(small, [("b", False), ("a", True)]).collect()] == [2, 4, 1, 3, 5]
    assert [r.a for r in aggregates.sort_rows(small, [("b", True), ("a", True)]).collect()] == [1, 3, 2, 4, 5]


def test_reduce_steps_in_order(spark, rows):
    data = [("p", 1, "u", 1.0), ("p", 1, "v", 2.0), ("p", 2, "u", 10.0), ("q", 1, "u", 5.0)]
    df = spark.createDataFrame(data, "k string, a int, b string, y double")
    assert rows(aggregates.reduce_dimensions(df, ["k"], "y", [("b", "sum"), ("a", "max")])) == [("p", 10.0), ("q", 5.0)]
    assert rows(aggregates.reduce_dimensions(df, ["k"], "y", [("a", "max"), ("b", "sum")])) == [("p", 12.0), ("q", 5.0)]
    assert rows(aggregates.reduce_dimensions(df, ["k"], "y", [("zz|b", "filter:u"), ("a", "sum")])) == [("p", 11.0), ("q", 5.0)]
    assert rows(aggregates.reduce_dimensions(df, ["k"], "y", [("b", "sum"), ("a", "first")])) == [("p", 3.0), ("q", 5.0)]


def test_select_leaves(spark):
    df = spark.createDataFrame([("m1-a-2024",), ("m1-b-2025",), ("m2-a-2023",)], "leaf string")
    pick = lambda *target: sorted(r.leaf for r in filters.select_leaves(df, "leaf", target).collect())
    assert pick("latest") == ["m1-b-2025"]
    assert pick("all", "a", "latest") == ["m1-a-2024"]
    assert pick("m1", "all", "all") == ["m1-a-2024", "m1-b-2025"]


def _fold(documents, keep_empty):
    """The rules one document after the other."""

    def merge(a, b):
        out = dict(a)
        for key, value in b.items():
            if key in out and not keep_empty and not value:
                continue
            if key in out and isinstance(out[key], dict) and isinstance(value, dict):
                out[key] = merge(out[key], value)
            elif key in out and isinstance(out[key], list) and isinstance(value, list) and not keep_empty:
                both = out[key] + value
                out[key] = [x for i, x in enumerate(both) if x not in both[:i]]
            else:
                out[key] = value
        return out

    whole = {}
    for document in documents:
        whole = merge(whole, document)
    return whole


def _rows_of(value, path=""):
    """(path, position) -> value as the merge shows it."""
    if isinstance(value, dict) and value or path == "":
        return {k: v for name, x in value.items() for k, v in _rows_of(x, f"{path}.{name}" if path else name).items()}
    show = lambda x: "null" if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True)
    if isinstance(value, list) and value:
        return {(path, i): show(x) for i, x in enumerate(value)}
    return {(path, None): show(value)}


def _merged(spark, cases, keep_empty):
    rows = [(k, n, json.dumps(d)) for k, docs in enumerate(cases) for n, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "k int, n int, doc string")
    out = {k: {} for k in range(len(cases))}
    for r in sets.merge_documents(df, "doc", ["k"], "n", keep_empty).collect():
        text = "null" if r.value is None else r.value
        if text[:1] in ("[", "{"):
            text = json.dumps(json.loads(text), sort_keys=True)
        out[r.k][r.path, r.position] = text.lower() if text in ("True", "False") else text
    return out


def _made_documents(seed):
    draw = random.Random(seed)
    scalars = [0, 1, 2.5, "", "0", "x", True, False, None]

    def value(depth):
        kind = draw.random()
        if kind < 0.35 and depth:
            return {draw.choice("abc"): value(depth - 1) for _ in range(draw.randrange(0, 3))}
        if kind < 0.6:
            return [draw.choice([*scalars, {"p": 1, "q": [1]}, {"q": [1], "p": 1}, {"q": []}, [], [1, 2], {}]) for _ in range(draw.randrange(0, 4))]
        return draw.choice(scalars)

    return [{draw.choice("abc"): value(3) for _ in range(draw.randrange(1, 3))} for _ in range(draw.randrange(1, 7))]


@pytest.mark.parametrize("keep_empty", [False, True])
def test_merged_documents_equal_the_fold(spark, keep_empty):
    named = [
        [{"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": 3}], [{"a": {"b": 1}}, {"a": 5}], [{"a": 5}, {"a": {"b": 1}}], [{"a": {"b": 1}}, {"a": ""}],
        [{"a": 7}, {"a": ""}], [{"a": 7}, {"a": "0"}], [{"l": ["a", "b"]}, {"l": ["b", "c"]}], [{"l": [1, 1]}], [{"l": [1, 1]}, {"l": []}], [{"l": [1, True]}, {"l": [1.0, 2]}],
        [{"l": [{"x": 1, "y": [1, {}]}]}, {"l": [{"y": [1, {}], "x": 1}, {"x": 2}]}], [{"a": {}}, {"a": {"b": {}}}], [{"a": 5}, {"a": {"b": 0}}], [{"a": None}, {"a": 0}],
        [{"l": [1]}, {"l": 3}, {"l": [2, 2]}], [{"l": [1]}, {"l": {"x": [5]}}, {"l": {"x": [6, 5]}}], [{"a": {"b": 1}}, {"a": 5}, {"a": {}}],
    ]
    cases = named + [_made_documents(seed) for seed in range(120)]
    got = _merged(spark, cases, keep_empty)
    for k, documents in enumerate(cases):
        assert got[k] == _rows_of(_fold(documents, keep_empty)), documents


def test_flatten_document(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}],"e":{}},"d":1.5,"l":[],"t":true,"n":null,"z":2.0}')], "id int, doc string")
    got = {r.path: r.value for r in columns.flatten_document(df, "doc", ["id"]).collect()}
    assert got == {"a.b.0": "1", "a.b.1.c": "x", "d": "1.5", "t": "True", "n": None, "z": "2.0"}
    got = {r.path for r in columns.flatten_document(df, "doc", ["id"], separator="/", parent="").collect()}
    assert "a/b/1/c" in got
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":1}}}}',)], "doc string")
    with pytest.raises(Exception, match="deeper than 2"):
        columns.flatten_document(deep, "doc", [], depth=2).collect()


def test_merged_documents_are_walked_once(spark, tmp_path):
    """All steps read what one walk found, and positions the digests worked out once: the result doesn't read the documents again."""
    spark.createDataFrame([(1, 1, '{"a":[{"x":1},2],"b":3}'), (1, 2, '{"a":[{"x":1.0}],"b":0}')], "k int, n int, doc string").write.parquet(str(tmp_path / "docs"))
    merged = sets.merge_documents(spark.read.parquet(str(tmp_path / "docs")), "doc", ["k"], "n")
    assert not [f for f in merged.inputFiles() if str(tmp_path) in f]
    got = sorted((r.path, r.position, r.value, r.kind) for r in merged.collect())
    assert got == [("a", 0, '{"x":1}', "list"), ("a", 1, "2", "list"), ("b", None, "3", "scalar")]
