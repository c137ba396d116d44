import random

import pytest

from gaugeframe.operators import series
from gaugeframe.operators.transforms import Axes, performance, relative_performance, speedup, transform
from gaugeframe.plans.plots import Plot, axis_labels, check_axes, default_label, plot_series

# Documented sample measurements: (tasks, elements) -> fill and compute seconds.
MEASURED = {
    (1, 10000): (28.9239, 1.92806), (2, 10000): (24.8636, 0.629236), (4, 10000): (2.89716, 0.0434488),
    (1, 20000): (63.0273, 3.74504), (2, 20000): (14.9139, 0.498528), (4, 20000): (36.537, 0.519222),
}
AXES = Axes(x="tasks", secondary="elements")


@pytest.fixture(scope="module")
def measured(spark):
    names = ("elapsed_fill", "elapsed_compute")
    data = [(n, v, float(t), float(e)) for (t, e), values in MEASURED.items() for n, v in zip(names, values)]
    return spark.createDataFrame(data, "perfvalue string, value double, tasks double, elements double")


def test_speedup_of_documented_values(measured):
    got = {(r.tasks, r.perfvalue): r.value for r in speedup(measured, AXES).where("elements = 10000").collect()}
    assert got[2.0, "elapsed_fill"] == pytest.approx(1.1633029810646889, rel=1e-12)
    assert got[2.0, "elapsed_compute"] == pytest.approx(3.064128562256451, rel=1e-12)
    assert got[4.0, "elapsed_fill"] == pytest.approx(9.983535600381062, rel=1e-12)
    assert got[4.0, "elapsed_compute"] == pytest.approx(44.375448804109666, rel=1e-12)
    assert [got[t, "optimal"] for t in (1.0, 2.0, 4.0)] == [1, 2, 4]
    assert [got[t, "half-optimal"] for t in (1.0, 2.0, 4.0)] == [1, 1.5, 2.5]


def test_relative_rows_sum_to_100(measured):
    cells = relative_performance(measured, AXES).collect()
    first = {r.perfvalue: r.value for r in cells if (r.tasks, r.elements) == (1.0, 10000.0)}
    assert first["elapsed_fill"] == pytest.approx(93.75060774096687, rel=1e-12)
    for key in MEASURED:
        assert sum(r.value for r in cells if (r.tasks, r.elements) == key) == pytest.approx(100)


def test_random_frames_keep_the_algebra(spark):
    random.seed(5)
    data = [(x, c, s, random.uniform(1, 9)) for x in (32, 64, 128) for c in ("M1", "M2") for s in "ABC"]
    df = spark.createDataFrame(data, "x bigint, color string, second string, value double")
    axes = Axes(x="x", color="color", secondary="second")
    base = {(c, s): v for x, c, s, v in data if x == 32}
    for r in speedup(df, axes).where("color like 'M%'").collect():
        y = next(v for x, c, s, v in data if (x, c, s) == (r.x, r.color, r.second))
        assert r.value == pytest.approx(base[r.color, r.second] / y)


def test_base_belongs_to_the_outer_group(spark, rows):
    df = spark.createDataFrame([(1, "a", 8.0), (2, "a", 4.0), (2, "b", 6.0), (4, "b", 3.0)], "x int, perfvalue string, value double")
    got = {(r.x, r.perfvalue): r.value for r in speedup(df, Axes(x="x")).collect()}
    assert got[2, "a"] == 2.0 and got[2, "b"] is None and got[4, "b"] is None


def test_zero_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0)], "x int, perfvalue string, value double")
    assert {r.value for r in speedup(df, Axes(x="x")).where("perfvalue = 'a'").collect()} == {None}
    assert {r.value for r in relative_performance(df, Axes(x="x")).collect()} == {None}
    assert speedup(df.where("x > 5"), Axes(x="x")).count() == 0


def test_duplicate_cell_fails_without_a_reduction(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "x int, perfvalue string, value double")
    with pytest.raises(Exception, match="several rows"):
        performance(df, Axes(x="x")).collect()
    assert performance(df.selectExpr("*", "value as run"), Axes(x="x"), [("run", "max")]).first().value == 2.0


def test_unknown_transformation_and_axis(measured):
    with pytest.raises(ValueError):
        transform(measured, "ratio", AXES)
    with pytest.raises(ValueError):
        performance(measured, Axes(x="threads"))


def test_axis_filter_forms():
    assert axis_labels("a") == {"a": "a"}
    assert axis_labels(["a", "b"]) == {"a": "a", "b": "b"}
    assert axis_labels({"a": "x"}) == {"a": "x"}
    assert axis_labels([{"a": "x"}, {"b": "y"}]) == {"a": "x", "b": "y"}
    assert axis_labels(None) == {} and default_label("num_cases") == "Num_Cases"


def test_plot_request(measured):
    kinds = ["scatter", "marked_scatter", "table", "stacked_bar", "grouped_bar", "heatmap", "sunburst", "parallelcoordinates", "scatter3d"]
    plot = Plot.from_config({"title": "t", "plot_types": kinds, "xaxis": {"parameter": "tasks"}, "secondary_axis": {"parameter": "elements"}})
    check_axes(plot, ["tasks", "elements"])
    with pytest.raises(ValueError):
        check_axes(plot, ["tasks"])
    shown = plot_series(measured, plot)
    assert {k: df.count() for k, df in shown.items()} == {
        "scatter": 12, "marked_scatter": 12, "table": 6, "stacked_bar": 12, "grouped_bar": 12,
        "heatmap": 4, "sunburst": 2 + 6 + 12, "parallelcoordinates": 12, "scatter3d": 12,
    }
    assert shown["heatmap"].columns == ["elements", "perfvalue", "1.0", "2.0", "4.0"]
    with pytest.raises(ValueError):
        Plot.from_config({"title": "t", "plot_types": ["pie"], "xaxis": {"parameter": "tasks"}})
    with pytest.raises(ValueError):
        Plot.from_config({"title": "t", "plot_types": [], "xaxis": {"parameter": "tasks"}, "aggregations": [{"column": "a", "agg": "mode"}]})


def test_stack_tops_and_frames(measured):
    bars = series.stacked_bar(performance(measured, AXES), AXES)
    tops = {(r.tasks, r.elements, r.perfvalue): r.stack_top for r in bars.collect()}
    assert tops["1.0", "10000.0", "elapsed_compute"] == pytest.approx(1.92806)
    assert tops["1.0", "10000.0", "elapsed_fill"] == pytest.approx(1.92806 + 28.9239)
    frames = series.slider_frames(performance(measured, AXES), AXES).orderBy("frame").collect()
    assert [(f.name, f.elements) for f in frames] == [("frame_0", 10000.0), ("frame_1", 20000.0)]
    assert frames[0].low == pytest.approx(0.0434488 * 0.99) and frames[0].high == pytest.approx(28.9239 + 0.0434488 * 0.01)
