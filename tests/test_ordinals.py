"""Positions, totals and codes against brute force, with one group holding most rows."""

import random
from collections import defaultdict

import pytest

from gaugeframe.operators import aggregates
from gaugeframe.operators.ordinals import cycle, dense_codes, group_ordinals, row_suffix, running_total

from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data():
    random.seed(3)
    keys = ["hot"] * 700 + [f"k{i % 40}" for i in range(300)] + [None] * 20
    return [(k, i * 3, random.choice(["b", "a", "ü", None]), random.randint(0, 9)) for i, k in enumerate(random.sample(keys, len(keys)))]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k string, at bigint, word string, v bigint").repartition(7)


def brute(data):
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: r[1]):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("width", [10, 1_000_000])
def test_group_ordinals(table, data, width):
    got = {r["at"]: r["i"] for r in group_ordinals(table, ["k"], "at", "i", width).collect()}
    assert got == {row[1]: i for group in brute(data).values() for i, row in enumerate(group)}


def test_global_ordinals_over_text_and_doubles(spark):
    words = sorted({f"{random.random():.6f}" for _ in range(2000)})
    df = spark.createDataFrame([(w, float(w)) for w in random.sample(words, len(words))], "w string, d double")
    for column in ("w", "d"):
        got = [r["w"] for r in group_ordinals(df, [], column, "i").orderBy("i").collect()]
        assert got == words
    assert [r["i"] for r in group_ordinals(df, [], "w", "i").orderBy("i").collect()] == list(range(len(words)))


@pytest.mark.parametrize("width", [10, 1_000_000])
def test_running_total(table, data, width):
    got = {r["at"]: r["total"] for r in running_total(table, ["k"], "at", "v", "total", width).collect()}
    want = {}
    for group in brute(data).values():
        total = 0
        for row in group:
            total += row[3]
            want[row[1]] = total
    assert got == want


def test_dense_codes(table, data):
    first = list(dict.fromkeys(r[2] for r in sorted(data, key=lambda r: r[1]) if r[2] is not None))
    codes = {w: first.index(w) for w in first} | {None: -1}
    got = {(r["word"], r["c"]) for r in dense_codes(table, "word", "c", order_by="at").select("word", "c").collect()}
    assert got == set(codes.items())
    by_value = {(r["word"], r["c"]) for r in dense_codes(table, "word", "c").select("word", "c").collect()}
    assert by_value == {("a", 0), ("b", 1), ("ü", 2), (None, -1)}


def test_cycle(spark):
    df = spark.createDataFrame([(-1,), (0,), (3,), (4,)], "c bigint")
    assert [r[0] for r in df.select(cycle(F.col("c"), ["x", "y", "z"])).collect()] == [None, "x", "x", "y"]


def test_row_suffix_only_for_repeated_metrics(spark, rows):
    df = spark.createDataFrame([(1, "m", 5), (1, "m", 9), (1, "n", 7), (2, "m", 8)], "case int, metric string, at bigint")
    got = rows(row_suffix(df, ["case"], "metric", "at", "name").select("case", "at", "name"))
    assert got == [(1, 5, "m_0"), (1, 7, "n"), (1, 9, "m_1"), (2, 8, "m")]


def test_exact_median_of_a_hot_group(table, data):
    import statistics

    got = {r["k"]: r["v"] for r in aggregates.exact_median(table.where("k is not null"), ["k"], "v").collect()}
    assert got == {k: statistics.median(r[3] for r in g) for k, g in brute(data).items() if k is not None}


def test_more_split_points_than_one_list_holds(spark):
    """Two levels of lists give the order that one gives, and neither list has all the points."""
    from gaugeframe.operators.ordinals import _with_bucket

    n = 4000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("at"), F.format_string("key %05d", F.col("id") * 7919 % n).alias("name"))
    for column in ("at", "name"):
        rows = _with_bucket(df, column, 3, most=16).select("at", "__bucket").orderBy("at").collect()
        buckets = [r["__bucket"] for r in rows]
        assert buckets == sorted(buckets) and len(set(buckets)) > 500
        assert max(buckets.count(b) for b in set(buckets)) < 60

