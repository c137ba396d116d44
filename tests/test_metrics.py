import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import metrics
from gaugeframe.operators.metrics import CustomVariable


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def named(df):
    return {r.name: r.value if r.value_str is None else r.value_str for r in df.collect()}


def test_csv_names_one_and_more_rows(spark):
    one = metrics.csv_metrics(files(spark, "col1,col2,col3\n1,2,5.5\n"), "text", ["id"])
    assert named(one) == {"col1": 1.0, "col2": 2.0, "col3": 5.5}
    two = metrics.csv_metrics(files(spark, "col1,col2\r\n\r\n1, x \n-1e3,10d\n"), "text", ["id"], "st")
    assert named(two) == {"st_col1_0": 1.0, "st_col2_0": "x", "st_col1_1": -1000.0, "st_col2_1": "10d"}


def test_csv_width_must_match(spark):
    with pytest.raises(Exception, match="differ in width"):
        metrics.csv_metrics(files(spark, "a,b\n1\n"), "text", ["id"]).collect()


def test_units(spark):
    df = metrics.csv_metrics(files(spark, "a,b\n1,2"), "text", ["id"], units={"*": "s", "b": "MB"})
    assert {r.name: r.unit for r in df.collect()} == {"a": "s", "b": "MB"}


def test_tsv_row_by_index(spark):
    text = "# nProc col1   col2   col3\n16 9 9 9\n32 1   2.5   1e-05\n32 7 7 7\n"
    assert named(metrics.tsv_metrics(files(spark, text), "text", ["id"], 32, "file")) == {
        "file_col1": 1.0, "file_col2": 2.5, "file_col3": 1e-05,
    }
    with pytest.raises(Exception, match="index not found"):
        metrics.tsv_metrics(files(spark, text), "text", ["id"], 64).collect()


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of 60 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_files_of_many_blocks_are_like_texts(spark, tmp_path, small_blocks, rows):
    """Blank lines, line ends of two systems, files of one row, of a header, of nothing; the order is that of the file."""
    texts = {
        "long.csv": "a, b,a\n" + "".join(f"{i},x{i} ,{-i}e-1\n" + "\n \n" * (i % 3 == 0) for i in range(90)),
        "crlf.csv": "\r\na,c\r\n" + "".join(f"{i}, {i * i}\r\n" for i in range(25)),
        "one.csv": "a,b\n1,2", "head.csv": "a,b\n", "none.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    got = metrics.csv_file_metrics(spark, str(tmp_path / "*.csv"), "st").withColumn("file", F.regexp_extract("file", r"[^/]+$", 0))
    assert spark.read.text(str(tmp_path / "long.csv")).rdd.getNumPartitions() > 5
    want = metrics.csv_metrics(spark.createDataFrame(list(texts.items()), "file string, text string"), "text", ["file"], "st")
    assert rows(got) == rows(want) and got.count() == 90 * 2 + 25 * 2 + 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1\n")
    with pytest.raises(Exception, match="differ in width"):
        metrics.csv_file_metrics(spark, str(tmp_path / "*.csv")).collect()


def test_tsv_files_of_many_blocks(spark, tmp_path, small_blocks, rows):
    def text(n):
        return "# n  t   v\n" + "".join(f" {i // 2 + n} {i}\t{i * 0.5}  \n" for i in range(60))

    texts = {f"{n}.tsv": text(n) for n in range(4)}
    for name, body in texts.items():
        (tmp_path / name).write_text(body)
    number = F.regexp_extract("file", r"(\d+)\.tsv$", 1)
    got = metrics.tsv_file_metrics(spark, str(tmp_path), (number.cast("int") * 2 + 20).cast("string"), "f")
    got = got.withColumn("file", F.regexp_extract("file", r"[^/]+$", 0))
    want = [(f"{n}.tsv", name, value, None, "s") for n in range(4) for name, value in (("f_t", 2.0 * (n + 20)), ("f_v", n + 20.0))]
    assert rows(got) == sorted(want, key=repr)
    with pytest.raises(Exception, match="index not found"):
        metrics.tsv_file_metrics(spark, str(tmp_path), "2").collect()


def test_regex_with_and_without_names(spark):
    text = "assembly: 0.012\nsolve: 1.42\npostprocess: n/a"
    pattern = r"^(?P<name>\w+):\s+(?P<value>\S+)$"
    assert named(metrics.regex_metrics(files(spark, text), "text", ["id"], pattern, "value", "name", "timers")) == {
        "timers_assembly": 0.012, "timers_solve": 1.42, "timers_postprocess": "n/a",
    }
    assert named(metrics.regex_metrics(files(spark, text), "text", ["id"], pattern, "value")) == {
        "match_0": 0.012, "match_1": 1.42, "match_2": "n/a",
    }


def test_regex_names_and_last_match(spark):
    text = "solve: 1\nload: 2\nsolve: 3\n"
    pattern = r"^(?P<var_name>\w+):\s+(?P<the_value>\S+)$"
    assert named(metrics.regex_metrics(files(spark, text), "text", ["id"], pattern, "the_value", "var_name")) == {"solve": 3.0, "load": 2.0}
    twice = r"(?P<a_b>\w)(?P=a_b) (?P<v>\d)"
    assert named(metrics.regex_metrics(files(spark, "xy 1 zz 2"), "text", ["id"], twice, "v", "a_b")) == {"z": 2.0}


def test_last_column_of_a_name_counts(spark):
    assert named(metrics.csv_metrics(files(spark, "a,b,a\n1,2,3\n"), "text", ["id"])) == {"a": 3.0, "b": 2.0}


def test_json_texts_stay_texts(spark):
    got = metrics.json_metrics(files(spark, '{"a":{"n":"12","m":12,"deep":{"x":{"y":{"z":{"u":{"v":[1,{"w":2}]}}}}}}}'), "text", ["id"], ["a"])
    assert {r.name: (r.value, r.value_str) for r in got.collect()} == {
        "a.n": (None, "12"), "a.m": (12.0, None), "a.deep.x.y.z.u.v.0": (1.0, None), "a.deep.x.y.z.u.v.1.w": (2.0, None),
    }


DOCUMENT = """{"field1":1.5,"field2":{"field2_1":2,"field2_2":{"x":3,"y":"z"}},
"hardware":{"gaya1":{"mem":{"total":{"host":64},"free":{"host":32}}},"gaya2":{"mem":{"total":{"host":128}}}}}"""


@pytest.mark.parametrize(
    "paths, want",
    [
        (["field1"], {"field1": 1.5}),
        (["field2.field2_1"], {"field2_1": 2.0}),
        (["field2.field2_2.*"], {"x": 3.0, "y": "z"}),
        (["field2"], {"field2.field2_1": 2.0, "field2.field2_2.x": 3.0, "field2.field2_2.y": "z"}),
        (["hardware.*.mem.*.host"], {"gaya1.total": 64.0, "gaya1.free": 32.0, "gaya2.total": 128.0}),
        (["hardware.*.mem.*"], {"gaya1.total.host": 64.0, "gaya1.free.host": 32.0, "gaya2.total.host": 128.0}),
        (["hardware.*.mem.total.host", "field1"], {"gaya1": 64.0, "gaya2": 128.0, "field1": 1.5}),
    ],
)
def test_json_paths(spark, paths, want):
    assert named(metrics.json_metrics(files(spark, DOCUMENT), "text", ["id"], paths)) == want


@pytest.mark.parametrize("path", ["field3", "field2.nothing", "hardware.*.disk", "field1.*", "hardware.*.mem.free.host", "field1.x"])
def test_an_absent_json_path_fails(spark, path):
    with pytest.raises(Exception, match="metric path"):
        metrics.json_metrics(files(spark, DOCUMENT), "text", ["id"], ["field1", path]).collect()


def test_json_keys_nulls_lists_and_depth(spark):
    deep = "".join(f'{{"k{i}":' for i in range(40)) + "7" + "}" * 40
    text = '{"a b":{"x\'y":[{"p":null},[],{},true,"t"],"[q]":1},"none":null,"deep":%s}' % deep
    got = metrics.json_metrics(files(spark, text), "text", ["id"], ["a b.*", "a b.[q]", "none", "deep"]).collect()
    rows = {r.name: (r.value, r.value_str) for r in got}
    assert rows == {
        "x'y.0.p": (None, None), "x'y.3": (None, "True"), "x'y.4": (None, "t"), "[q]": (1.0, None), "none": (None, None),
        "deep." + ".".join(f"k{i}" for i in range(40)): (7.0, None),
    }


def test_json_walk_reads_paths_only(spark):
    """One projection and one generator; nothing runs while the plan is built."""
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = metrics.json_metrics(files(spark, DOCUMENT), "text", ["id"], ["hardware.*.mem.*", "field1"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and "Exchange" not in plan


def test_last_stage_wins(spark):
    first = metrics.csv_metrics(files(spark, "a,b\n1,x"), "text", ["id"])
    second = metrics.csv_metrics(files(spark, "b\n2"), "text", ["id"])
    assert named(metrics.merge_stages([first, second], ["id"])) == {"a": 1.0, "b": 2.0}


def test_custom_variables_use_earlier_ones(spark):
    df = spark.createDataFrame([(1, "col1", 1.0), (1, "col2", 2.0), (1, "col3", 5.5)], "id int, name string, value double")
    variables = [
        CustomVariable("s", "sum", ("col1", "col3")), CustomVariable("m", "max", ("col1", "col2")),
        CustomVariable("a", "mean", ("s", "m", "col1")), CustomVariable("all", "min", ("a", "s", "m"), "ms"),
    ]
    got = {r.name: (r.value, r.unit) for r in metrics.custom_variables(df, ["id"], variables).collect()}
    assert got["s"] == (6.5, "s") and got["m"] == (2.0, "s") and got["all"] == (2.0, "ms")
    assert got["a"][0] == pytest.approx(9.5 / 3)
    with pytest.raises(Exception, match="not found"):
        metrics.custom_variables(df, ["id"], [CustomVariable("q", "sum", ("zz",))]).collect()
    with pytest.raises(ValueError):
        metrics.custom_variables(df, ["id"], [CustomVariable("q", "mode", ("col1",))])


def test_log_checks_take_literals(spark):
    logs = spark.createDataFrame([("a", "done [ok] (1+1)"), ("b", "done"), ("b", "[fail]"), ("c", None)], "id string, text string")
    got = {r.id: (r.success, r.no_errors, r.passed) for r in metrics.check_logs(logs, "text", ["id"], ["done"], ["[fail]"]).collect()}
    assert got == {"a": (True, True, True), "b": (False, False, False), "c": (False, True, False)}
    free = metrics.check_logs(logs, "text", ["id"], ["(1+1)"]).where(F.col("passed")).collect()
    assert [r.id for r in free] == ["a"]
