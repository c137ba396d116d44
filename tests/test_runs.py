import json

import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import hierarchy, runs
from gaugeframe.sources.readers import report_tree
from gaugeframe.streaming import ingest


def case(i, result="pass", perf=None, params=None):
    return {"hashcode": f"h{i}", "system": "gaia", "partition": "p", "result": result, "time_total": 1.0 * i,
            "check_params": params or {}, "perfvalues": perf}


REPORT = {
    "session_info": {"hostname": "n", "num_cases": 3, "num_failures": 1},
    "runs": [
        {"run_index": 0, "num_cases": 3, "num_failures": 1, "testcases": [
            case(1, perf={"gaia:p:t": [1.5, 0, None, 0.1, "s", "pass"], "gaia:p:kind": ["fast", 0, None, None, "text", "pass"]},
                 params={"tasks": 4, "mem": {"size": "L", "gb": 2.0}, "flag": True}),
            case(2, "fail", perf={}, params={"tasks": 8}),
            case(3, perf={"gaia": [7, 0, None, None, "s", "pass"]}),
        ]},
        {"run_index": 1, "num_cases": 1, "num_failures": 0, "testcases": [case(4, perf=None)]},
    ],
}


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame([("leaf", json.dumps(REPORT))], "leaf string, report string")
    return runs.run_facts(runs.parse_reports(df, "report"))


def test_every_case_and_metric_has_a_row(facts):
    got = sorted((r["testcases.hashcode"], r.perfvalue or "", r.value, r.value_str, r.result, r["runs.run_index"]) for r in facts.collect())
    assert got == [
        ("h1", "kind", None, "fast", "pass", 0), ("h1", "t", 1.5, None, "pass", 0), ("h2", "", None, None, "fail", 0),
        ("h3", "", 7.0, None, "pass", 0), ("h4", "", None, None, "pass", 1),
    ]


def test_run_columns_reach_every_row(facts):
    assert {(r["runs.run_index"], r["runs.num_cases"]) for r in facts.collect()} == {(0, 3), (1, 1)}


def test_missing_parts_and_bare_cases(facts):
    rows = {(r["testcases.hashcode"], r.perfvalue): (r.system, r.partition) for r in facts.collect()}
    assert rows["h3", None] == ("gaia", None) and rows["h2", None] == ("gaia", "p") and rows["h1", "t"] == ("gaia", "p")


def test_parameters(facts):
    params = {r["testcases.hashcode"]: r.params for r in facts.collect()}
    assert params["h1"] == {"tasks": "4", "mem.size": "L", "mem.gb": "2.0", "flag": "True"}
    assert params["h2"] == {"tasks": "8"} and params["h3"] == {}
    wide = runs.parameter_columns(facts, ["tasks", "mem.size"]).where("perfvalue = 't'").first()
    assert (wide["tasks"], wide["mem.size"]) == ("4", "L")


def test_facts_need_no_shuffle(facts):
    assert "Exchange" not in facts._jdf.queryExecution().executedPlan().toString()


def test_empty_and_broken_reports(spark):
    assert runs.empty_facts(spark).count() == 0 and "runs.run_index" in runs.empty_facts(spark).columns
    broken = spark.createDataFrame([('{"runs": [',)], "report string")
    with pytest.raises(Exception):
        runs.run_facts(runs.parse_reports(broken, "report")).collect()


LEAVES = [
    ("l1", "2024-01-01", 0, 3, 1, "pass", "m1", "a"), ("l1", "2024-01-01", 0, 3, 1, None, "m1", "a"),
    ("l1", "2024-01-01", 1, 9, 9, "pass", "m1", "a"), ("l2", "2024-02-01", 0, 2, 0, "pass", "m1", "b"),
    ("l3", "2024-02-01", 0, 2, 0, "fail", "m1", "a"), ("l4", "2024-01-15", 0, 5, 0, "pass", "m2", "a"),
    (None, "2024-03-01", 0, 9, 9, "fail", "m2", "a"),
]


@pytest.fixture(scope="module")
def leaf_facts(spark):
    names = "leaves string, date string, `runs.run_index` bigint, `runs.num_cases` bigint, `runs.num_failures` bigint, result string, machines string, use_cases string"
    return spark.createDataFrame(LEAVES, names)


def test_leaf_and_group_summary(leaf_facts):
    leaves = runs.leaf_summary(leaf_facts, levels=["machines", "use_cases"])
    got = {r.leaves: (r.num_runs, r.num_cases, r.num_failures, r.result) for r in leaves.collect()}
    assert got == {"l1": (2, 3, 1, "fail"), "l2": (1, 2, 0, "pass"), "l3": (1, 2, 0, "fail"), "l4": (1, 5, 0, "pass")}
    groups = {r.machines: tuple(r)[1:] for r in runs.group_summary(leaves, "machines").collect()}
    assert groups == {"m1": (4, 7, 1, "fail", "2024-02-01", "l3"), "m2": (1, 5, 0, "pass", "2024-01-15", "l4")}


def test_latest_reports(leaf_facts):
    top = runs.latest_reports(leaf_facts, 3, levels=["machines", "zz"]).collect()
    assert [(r.leaves, r.status) for r in top] == [("l3", "🟢"), ("l2", "🟢"), ("l4", "🟢")]
    assert "zz" not in top[0].asDict()


def test_rollup_holds_the_union_of_the_leaves(leaf_facts):
    leaves = runs.leaf_summary(leaf_facts, levels=["machines", "use_cases"])
    up = hierarchy.roll_up(leaves, ["machines", "use_cases"], {"cases": F.sum("num_cases"), "n": F.count(F.lit(1))})
    got = {(r.depth, r.machines, r.use_cases): (r.cases, r.n) for r in up.collect()}
    assert got[0, None, None] == (12, 4) and got[1, "m1", None] == (7, 3) and got[2, "m1", "a"] == (5, 2)
    views = hierarchy.roll_up_views(leaves, [["machines", "use_cases"], ["use_cases", "machines"]], {"n": F.count(F.lit(1))})
    placed = {(r.view, r.depth, r.machines, r.use_cases): r.n for r in views.collect()}
    assert placed[0, 0, None, None] == placed[1, 0, None, None] == 4
    assert placed[1, 1, None, "a"] == 3 and placed[0, 2, "m1", "a"] == placed[1, 2, "m1", "a"] == 2
    assert len(placed) == 2 * (1 + 2 + 3)


def test_mapping_paths_and_permutation(spark, rows):
    mapping = {"m1": {"app": {"u1": {"path": "x", "tags": 1}, "u2": {"path": "y"}}, "short": {"path": "z"}}, "m2": {}}
    df = spark.createDataFrame([(json.dumps(mapping),)], "doc string")
    paths = hierarchy.mapping_paths(df, "doc", ["machine", "app", "use_case"])
    got = {(r.machine, r.app, r.use_case): r.leaf for r in paths.collect()}
    assert got == {("m1", "app", "u1"): {"path": "x", "tags": "1"}, ("m1", "app", "u2"): {"path": "y"}, ("m1", "short", None): {"path": "z"}}
    flat = spark.createDataFrame([("a", "b", "l1"), ("a", "c", "l2"), ("a", "c", "l2")], "x string, y string, leaf string")
    assert rows(hierarchy.permute_levels(flat, ["x", "y"], [1, 0, 5], "leaf")) == [("b", "a", "l1"), ("c", "a", "l2")]
    assert rows(hierarchy.nodes_of(flat, ["x", "y"])) == [(1, "a", "", 3), (2, "a-b", "a", 1), (2, "a-c", "a", 2)]


def test_level_order_and_upsert(spark, rows):
    paths = spark.createDataFrame([("m1", "a1"), ("m1", "a2")], "l1 string, l2 string")
    kinds = spark.createDataFrame([("m1", "machines"), ("a1", "apps"), ("a2", "apps"), ("q", "none")], "node string, kind string")
    assert rows(hierarchy.level_order(paths, ["l1", "l2"], kinds, "node", "kind")) == [("apps", 1), ("machines", 0)]
    old = spark.createDataFrame([("k", 9, "old", "Given")], "key string, at int, path string, title string")
    new = spark.createDataFrame([("k", 1, "p1", "K"), ("k", 2, "p2", "K"), ("j", 1, "q", "J")], old.schema)
    assert rows(hierarchy.upsert_catalogue(old, new, ["key"], "at", "path", "title")) == [("j", "q", "J"), ("k", "p2", "Given")]


def _write(base, app, case_name, machine, date, report):
    folder = base / app / case_name / machine / date
    folder.mkdir(parents=True)
    (folder / "run.json").write_text(json.dumps(report, indent=1))


LEVELS = ["application", "use_case", "machine"]


def test_report_tree(spark, tmp_path):
    _write(tmp_path, "app", "u1", "m1", "2024_05_01T10_20_30", REPORT)
    _write(tmp_path, "app", "u2", "m1", "2024_05_02T00_00_00", {"runs": []})
    tree = report_tree(spark, str(tmp_path), LEVELS, "run.json", runs.report_schema())
    got = {r.leaf: (r.application, r.use_case, r.machine, str(r.date)) for r in tree.collect()}
    assert got == {
        "app-u1-m1-2024_05_01T10_20_30": ("app", "u1", "m1", "2024-05-01 10:20:30"),
        "app-u2-m1-2024_05_02T00_00_00": ("app", "u2", "m1", "2024-05-02 00:00:00"),
    }
    assert runs.run_facts(tree).count() == 5


def test_streams_follow_new_reports_and_count_a_resent_leaf_once(spark, tmp_path):
    base = tmp_path / "tree"
    source = f"{base}/*/*/*/*/*.json"
    flatten = lambda df: runs.run_facts(df).withColumnRenamed("leaf", "leaves")

    def run():
        reports = ingest.report_stream(spark, source, runs.report_schema(), LEVELS)
        ingest.ingest(reports, flatten, str(tmp_path / "facts"), str(tmp_path / "c1")).awaitTermination()
        reports = ingest.report_stream(spark, source, runs.report_schema(), LEVELS)
        ingest.keep_summaries(reports, flatten, str(tmp_path / "log"), str(tmp_path / "c2"), "leaves", ["machine"]).awaitTermination()
        return {r.leaves: (r.num_runs, r.result) for r in ingest.current_leaves(spark, str(tmp_path / "log")).collect()}

    _write(base, "app", "u1", "m1", "2024_05_01T10_20_30", REPORT)
    assert run() == {"app-u1-m1-2024_05_01T10_20_30": (2, "fail")}
    _write(base, "app", "u1", "m1", "2023_01_01T00_00_00", {"runs": [REPORT["runs"][1]]})
    fixed = {"runs": [REPORT["runs"][1]]}
    (base / "app" / "u1" / "m1" / "2024_05_01T10_20_30" / "again.json").write_text(json.dumps(fixed))
    assert run() == {"app-u1-m1-2024_05_01T10_20_30": (2, "pass"), "app-u1-m1-2023_01_01T00_00_00": (2, "pass")}
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 5 + 1 + 1
    leaves = ingest.current_leaves(spark, str(tmp_path / "log"))
    summary = runs.group_summary(leaves, "machine").first()
    assert (summary.num_runs, summary.result, summary.latest_leaf) == (4, "pass", "app-u1-m1-2024_05_01T10_20_30")


def test_fold_up_sees_the_results_of_children(spark):
    from gaugeframe.operators import hierarchy

    paths = spark.createDataFrame([("e", "x", "b1", 4), ("e", "x", "b2", 6), ("e", "y", "b3", 1), ("w", "z", "b4", 9)], "side string, town string, leaf string, n int")
    results = {"side": {"n": F.max("n"), "top": F.max_by("town", "n")}, None: {"n": F.sum("n"), "tops": F.sort_array(F.collect_set("top"))}}
    tables = hierarchy.fold_up(paths, ["side", "town"], {"n": F.sum("n")}, results.__getitem__)
    assert {tuple(r) for r in tables["town"].collect()} == {("e", "x", 10), ("e", "y", 1), ("w", "z", 9)}
    assert {tuple(r) for r in tables["side"].collect()} == {("e", 10, "x"), ("w", 9, "z")}
    assert tables["root"].first().asDict() == {"n": 19, "tops": ["x", "z"]}
    assert tables["root"]._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def _leaves(spark, rows):
    return spark.createDataFrame(rows, "leaves string, num_runs int")


def test_batches_replace_leaves_and_may_run_again(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    state = {}

    def batch(number, rows):
        ingest.merge_batch(_leaves(spark, rows), log, number, buckets=4)

    def seen():
        return {r.leaves: r.num_runs for r in ingest.current_leaves(spark, log).collect()}

    with pytest.raises(ValueError, match="no batch"):
        ingest.current_leaves(spark, log)
    for number in range(6):
        rows = [(f"leaf{(number * 3 + i) % 10}", number * 100 + i) for i in range(4)]
        batch(number, rows)
        state.update(rows)
        assert seen() == state
        batch(number, rows)  # once more, after it was done
        assert seen() == state
    files = len(ingest.current_leaves(spark, log).inputFiles())
    # The data of a batch are written, the list of slots is not: nothing is seen, and the next run mends it.
    real = spark.createDataFrame
    rows = [("leaf1", -1), ("new", -2)]
    new = _leaves(spark, rows)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.merge_batch(new, log, 6, buckets=4)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: real(*a, **k))
    assert seen() == state
    batch(6, rows)
    assert seen() == state | dict(rows)
    batch(7, [])
    assert seen() == state | dict(rows)
    assert len(ingest.current_leaves(spark, log).inputFiles()) <= 2 * 4 and files <= 2 * 4  # a file a bucket and slot


def test_a_bucket_of_many_leaves_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "LEAVES_A_TASK", 20)
    log = str(tmp_path / "log")
    for number in range(2):
        ingest.merge_batch(_leaves(spark, [(f"l{i}", number) for i in range(200)]), log, number, buckets=2)
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "log" / "leaves").glob("slot=*/bucket=*")]
    assert len(files) == 4 and min(files) > 1
    found = [(r.leaves, r.num_runs) for r in ingest.current_leaves(spark, log).collect()]
    assert sorted(found) == sorted((f"l{i}", 1) for i in range(200))
