import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import grids
from gaugeframe.operators.grids import Parameter


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: grids.linspace(0, 10, 5), [0, 2.5, 5, 7.5, 10]),
        (lambda: grids.linspace(3, 10, 1), [3]),
        (lambda: grids.geomspace(1, 1000, 4), [1, 10, 100, 1000]),
        (lambda: grids.geometric(5, -1, 5), [5, -5, 5, -5, 5]),
        (lambda: grids.geometric(2, 3, 4), [2, 6, 18, 54]),
        (lambda: grids.value_range(10, 0, -2), [10, 8, 6, 4, 2, 0]),
        (lambda: grids.value_range(0, 10, 5), [0, 5, 10]),
        (lambda: grids.value_range(0, 10, 3), [0, 3, 6, 9, 12]),
        (lambda: grids.values(["a", "b"]), ["a", "b"]),
        (lambda: grids.repeat("x", 3), ["x", "x", "x"]),
    ],
)
def test_generators(one, make, want):
    assert one.select(make()).first()[0] == pytest.approx(want) if not isinstance(want[0], str) else want


def test_zip_stops_at_the_shortest_and_nests(one):
    inner = grids.zipped({"n": grids.value_range(0, 10, 5), "m": grids.linspace(0, 5, 3)})
    outer = grids.zipped({"inner": inner, "tag": grids.values(["a", "b"])})
    got = one.select(outer).first()[0]
    assert [(r.inner.n, r.inner.m, r.tag) for r in got] == [(0, 0, "a"), (5, 2.5, "b")]


def test_pruned_grid(one):
    conditions = {"M1": [{"memory": [512]}], "M2": [{"memory": [1024]}], "M3": [{"memory": [2048]}]}
    parameters = [
        Parameter("mesh", grids.values(["M1", "M2", "M3"]), conditions=conditions),
        Parameter("memory", grids.values([512, 1024, 2048])),
        Parameter("off", grids.values([1, 2, 3]), active=False),
    ]
    got = grids.parameter_grid(one, parameters)
    assert sorted((r.mesh, r.memory) for r in got.collect()) == [("M1", 512), ("M2", 1024), ("M3", 2048)]
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_conditions_read_nested_values_and_leave_others_free(one):
    conditions = {"2.0": [{"res.tasks": [1], "kind": ["a"]}, {"res.tasks": [2]}]}
    parameters = [
        Parameter("x", grids.linspace(1, 2, 2), conditions=conditions),
        Parameter("res", grids.values([{"tasks": 1}, {"tasks": 2}, {"tasks": 3}])),
        Parameter("kind", grids.values(["a", "b"])),
    ]
    got = grids.flatten_parameters(grids.parameter_grid(one, parameters), ["res"])
    kept = sorted((r["x"], r["res.tasks"], r["kind"]) for r in got.collect())
    assert [k for k in kept if k[0] == 2.0] == [(2.0, 1, "a"), (2.0, 2, "a"), (2.0, 2, "b")]
    assert len([k for k in kept if k[0] == 1.0]) == 6


def test_grid_size_is_the_product(one):
    sizes = [4, 3, 3]
    parameters = [Parameter(f"p{i}", grids.values(list(range(n)))) for i, n in enumerate(sizes)]
    assert grids.parameter_grid(one, parameters).count() == 36
    assert grids.parameter_grid(one, [*parameters, Parameter("none", grids.linspace(0, 1, 0))]).count() == 0


def test_conditions_are_tested_while_the_grid_grows(one):
    """The condition on the first and the last parameter is tested before the two between them are combined."""
    conditions = {str(i): [{"last": [i]}] for i in range(10)}
    parameters = [
        Parameter("first", grids.values(list(range(10))), conditions=conditions),
        Parameter("wide", grids.values(list(range(50)))),
        Parameter("double", F.transform(grids.values([1, 2]), lambda x: x + F.col("wide"))),
        Parameter("last", grids.values(list(range(10)))),
    ]
    assert [p.name for p in grids.growing_order(one, parameters)] == ["first", "last", "wide", "double"]
    got = grids.parameter_grid(one, parameters)
    assert got.columns == [*one.columns, "first", "wide", "double", "last"]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [i for i, line in enumerate(plan) if "Generate" in line]
    assert any("Filter" in line and "first" in line and "last" in line for line in plan[made[1] : made[2]])
    rows = got.collect()
    assert len(rows) == 10 * 50 * 2 and all(r.first == r.last and r.double - r.wide in (1, 2) for r in map(_named, rows))


def _named(row):
    from types import SimpleNamespace

    return SimpleNamespace(**row.asDict())


def test_conditions_on_absent_parameters_fail(one):
    with pytest.raises(ValueError, match="nowhere"):
        grids.parameter_grid(one, [Parameter("a", grids.values([1]), conditions={"1": [{"nowhere": [1]}]})])
