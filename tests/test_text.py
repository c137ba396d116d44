import math
import random
import string
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions import scalars, text
from gaugeframe.functions.columns import number_text
from gaugeframe.sources.readers import relaxed_json


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.fixture(scope="module")
def numbers(spark):
    random.seed(11)
    values = [2.25, 2.45, 1.005, 0.15, 0.25, -2.5, -0.04, -0.0, 0.0, 0.5, 1.5, 1e7, 1e16, 1e-5, 12345678.9, 99.995, 1e20]
    values += [float("nan"), float("inf"), float("-inf"), 0.001, 0.00012345, 123456789012345.67, 2.0**52 + 0.5, 2.0**53 + 2, 9007199254740993.5, 1e18, 0.9999999, 1e30]
    values += [random.uniform(-1e6, 1e6) for _ in range(300)] + [round(random.uniform(-99, 99), 2) + 0.005 for _ in range(300)]
    return values, spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("template", ["%.0f", "%.1f", "%.2f", "%.3f EUR", "%8.1f|", "%-8.1f|", "%08.1f", "%+.1f", "100%% of %.1f"])
def test_printf_is_python(numbers, template):
    values, df = numbers
    got = [r[0] for r in df.select(scalars.printf(F.col("x"), T.DoubleType(), template)).collect()]
    assert list(got) == [template % v for v in values]


@pytest.fixture(scope="module")
def wide_numbers(spark):
    """Doubles of all exponents, ties of every length and the ends of the range."""
    rng = random.Random(5)
    values = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(400)]
    values = [v for v in values if math.isfinite(v)]
    values += [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 8e37, 1e22, 1e23, 2.0**200, 2.0**-1074 * 3, 2.0**-44, 2e-3]
    values += [0.0, -0.0, 1.0, 9.5, 99.5, 999999.5, 9999995.0, 0.00009999995, 0.0001, 1e15, 1e16, 2.5, 3.5, 0.125, 12345.0, float("nan"), float("inf"), float("-inf")]
    values += [(rng.randrange(10**6) + 0.5) * 2.0 ** rng.randrange(-40, 40) for _ in range(200)]
    return values, spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize(
    "template", ["%e", "%.0e", "%.3e", "%.15e", "%.40e", "%g", "%.0g", "%.3G", "%.17g", "%.30g", "%#.4g", "%#.0e", "%#.0f", "%.0f", "%.3f", "%.20f", "%.400f", "%012.2e"]
)
def test_printf_of_any_size_is_python(wide_numbers, template):
    values, df = wide_numbers
    got = [r[0] for r in df.select(scalars.printf(F.col("x"), T.DoubleType(), template)).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != template % v] == []


def test_whole_numbers_of_any_size(spark, wide_numbers):
    values = [v for v in wide_numbers[0] if math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in scalars.format_columns(df, {"x": "<%d>"}).collect()] == ["<%d>" % v for v in values]


def test_number_text_is_python(numbers):
    values, df = numbers
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [str(v) for v in values]


def test_printf_by_type(spark):
    df = spark.createDataFrame([(7.9, "t", True, 3), (None, None, None, None)], "d double, s string, b boolean, i int")
    got = scalars.format_columns(df, {"d": "%i", "s": "%.2f", "b": "%d", "i": {"3": "three"}, "zz": "%d"}).collect()
    # A cell that %d can't print makes the whole column plain texts.
    assert tuple(got[0]) == ("7.9", "t", "True", "three")
    assert tuple(got[1]) == ("nan", None, "None", None)
    whole = scalars.format_columns(df.where("i is not null"), {"d": "%i", "b": "%d", "i": "%03d"}).first()
    assert tuple(whole) == ("7", "t", "1", "003")
    gaps = spark.createDataFrame([(1, 2), (None, 3)], "a int, b int")
    assert [tuple(r) for r in scalars.format_columns(gaps, {"a": "%d", "b": "%d"}).collect()] == [("1.0", "2"), ("nan", "3")]
    assert scalars.format_columns(gaps.where("b > 9"), {"a": "%d"}).collect() == []
    assert one(spark, scalars.printf(F.lit(1234.5), T.DoubleType(), "%.3g")) == "%.3g" % 1234.5
    assert one(spark, scalars.printf(F.lit(0.25), T.DoubleType(), "%g")) == "0.25"


def test_names(spark):
    assert one(spark, scalars.sanitize(F.lit("a b/é_1.x-ß^"))) == "a-bé_1.x-ß"
    random.seed(2)
    words = ["num_cases", "o'neil ABC", "x1y", "élan vital", "ßa", "a  b", "", "_a_", " lead"]
    words += ["".join(random.choices(string.ascii_letters + " _1é", k=12)) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(scalars.title_label(F.col("w")), scalars.capitalise_words(F.col("w"))).collect()
    assert [r[0] for r in got] == [w.title() for w in words]
    assert [r[1] for r in got] == [string.capwords(w) for w in words]


def test_dates_durations_quotes(spark):
    assert str(one(spark, scalars.leaf_date(F.lit("2024_05_01T10_20_30")))) == "2024-05-01 10:20:30"
    assert one(spark, scalars.leaf_date(F.lit("draft"))) is None
    assert one(spark, scalars.duration_seconds(F.lit("1-2:03:4"))) == 86400 + 7200 + 180 + 4
    for bad in ("1-24:00:00", "1-2:60:00", "2:00:00", "x"):
        assert one(spark, scalars.duration_seconds(F.lit(bad))) is None
    assert one(spark, scalars.strip_quotes(F.lit('""a "b" c"'))) == 'a "b" c'
    assert one(spark, scalars.strip_newlines(F.lit("\n a\nb \n"))) == "a b"
    assert one(spark, scalars.split_part(F.lit("s:p"), ":", 2)) is None


DATA = """parse_json('{"a":{"b":["x",{"c":1.5}],"n":null,"t":true,"0":"z"},"s":"abc","f":18.0}')"""
TEXTS = {
    "v @{a.b.0}@ @{a.b.1.c}@": "v x 1.5",
    "@{a.n}@ @{a.t}@ @{a.0}@ @{f}@": "None True z 18.0",
    "@{a.b | length}@ @{s|length}@ @{a | length}@": "2 3 4",
    "@{zz}@ @{a..b}@ @{a.b.7}@ @{s | upper}@": "@{zz}@ @{a..b}@ @{a.b.7}@ abc",
    "none": "none",
    "": "",
}


@pytest.mark.parametrize("template", TEXTS)
def test_fill_text_fixed_and_column(spark, template):
    assert one(spark, text.fill_text(template, F.expr(DATA))) == TEXTS[template]
    df = spark.createDataFrame([(template,)], "t string").withColumn("v", F.expr(DATA))
    assert df.select(text.fill_text(F.col("t"), F.col("v"))).first()[0] == TEXTS[template]


LONG = {f"k{i}": f"{{{{k{i + 1}}}}}" for i in range(40)} | {"k40": "end"}


@pytest.mark.parametrize(
    "target, lookup, want",
    [
        ("no names", {"no": "yes"}, "no names"),
        ("{{k0}}/{{ k39 }}", LONG, "end/end"),
        ("{{dir.{{os}}}}.log", {"os": "bsd", "dir.bsd": "/var/{{sub}}", "sub": "adm"}, "/var/adm.log"),
        ("{{l.{{m.{{n}}}}}}", {"n": "1", "m.1": "2", "l.2": "deep"}, "deep"),
        ("{{gone}} {{dir.{{os}}}}", {"os": "bsd"}, "{{gone}} {{dir.bsd}}"),
        ("{{p}} {{q}} {{r}}", {"p": "{{q}}", "q": "{{p}}", "r": "to {{p}}"}, "{{p}} {{q}} to {{p}}"),
        ("{{me}}!", {"me": "{{me}}{{me}}"}, "{{me}}!"),
        ("{{two words}} {{}}", {"two words": "ok"}, "ok {{}}"),
        ("x{{e}}y", {"e": ""}, "xy"),
        ("{{z}}", {}, "{{z}}"),
        ("{{z}}", None, "{{z}}"),
    ],
)
def test_fill_config(spark, target, lookup, want):
    df = spark.createDataFrame([(target, lookup)], "t string, m map<string,string>")
    assert text.fill_config(df, "t", "m").first().t == want


LADDER = {f"n{i}": f"{{{{ n{i + 1} }}}}{{{{n{i + 1}}}}}" for i in range(8)} | {"n8": "x"}
RINGS = {"a": "{{b}}", "b": "{{c}} {{gone}}", "c": "{{a}}", "in": "{{a}}{{ok}}", "ok": "y", "self": "-{{ self }}", "null": None}


@pytest.mark.parametrize(
    "target, lookup, want",
    [
        ("{{n0}}", LADDER, "x" * 256),
        ("{{in}} {{b}} {{self}}", RINGS, "{{a}}y {{b}} {{self}}"),
        ("{{null}} {{ok}}", RINGS, "{{null}} {{ok}}"),
        ("{{x{{y}}}}", {"y": "1", "x1": "{{x{{y}}}}"}, "{{x{{y}}}}"),
        (None, {"a": "b"}, None),
    ],
)
def test_fill_config_ladders_and_rings(spark, target, lookup, want):
    df = spark.createDataFrame([(1, target, lookup), (2, "{{ok}}", {"ok": "2"})], "id int, t string, m map<string,string>")
    assert {r.id: r.t for r in text.fill_config(df, "t", "m").collect()} == {1: want, 2: "2"}


def test_fill_config_works_a_chain_out_in_one_step(spark):
    df = spark.createDataFrame([("{{a}}", {"a": "b"})], "t string, m map<string,string>")
    plan = text.fill_config(df, "t", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence" not in plan


@pytest.mark.parametrize(
    "markup, latex",
    [
        ("50% *bold* a*b*c", r"50\% \textbf{bold} a*b*c"),
        ("stem:[ x^2 ]", "$x^2$"),
        ("(https://a.b/c[ Label ]).", r"(\href{https://a.b/c}{Label})."),
        ("http://x.y[]", r"\url{http://x.y}"),
        ("http://a[b],http://c[]", r"\href{http://a}{b},\url{http://c}"),
        ("<<ref, Text>> <<r2>>", r"\hyperlink{ref}{Text} \ref{r2}"),
        ("_it_ stays", "_it_ stays"),
    ],
)
def test_markup_to_latex(spark, markup, latex):
    assert one(spark, text.markup_to_latex(F.lit(markup))) == latex


def test_latex_escape_order(spark):
    assert one(spark, text.latex_escape(F.lit("a_b & 5% {x} ~^#$"))) == r"a\_b \& 5\% \{x\} \textasciitilde{}\^{}\#\$"
    assert one(spark, text.latex_escape(F.lit("\\"))) == r"\textbackslash\{\}"


def test_relaxed_json(spark):
    loose = '{ // c\n "a": "http://x /* no */", /* b\n*/ "l": [1, 2, /* z */ ],\n "q": "say \\"// hi\\"", }'
    import json

    assert json.loads(one(spark, relaxed_json(F.lit(loose)))) == {"a": "http://x /* no */", "l": [1, 2], "q": 'say "// hi"'}
