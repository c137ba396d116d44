import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import quality


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(words) - 7):
        count.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in count.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a b c d e f g h " * 3 + "end", "x " * 500, "a\n a\na \na\n\n\n",
    " ".join(map(str, range(100))), "é#ß* $% &|<> " * 30, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 2 + " ".join(f"u{i}" for i in range(200)), "long " * 30000,
    "\x0b\x0c\r x y   z", "line one\nline two\nline one\n  \n  \n" * 5,
]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_words int")
    got = quality.judge_quality(docs, "doc_id", "text", "lang", "source").orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [brute_base(t) for t in TEXTS]
    assert all(not (r.kept and r.base_failed) for r in got)


def test_nulls_copies_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "a", "en", "s"), (1, "a", "en", "s")], "doc_id bigint, text string, lang string, source string")
    assert quality.judge_quality(docs, "doc_id", "text", "lang", "source").count() == 3
    assert quality.judge_quality(docs.where("false"), "doc_id", "text", "lang", "source").collect() == []


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: brute_base(r.text) for r in docs.collect()}
    got = quality.judge_quality(docs, "doc_id", "text", "lang", "source").collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == rows


@pytest.mark.parametrize("rows", [40, 400])
def test_cutoffs_follow_the_group(spark, rows):
    """What is usual in one source is an outlier in another; a small source follows its language."""
    plain = lambda i: " ".join(f"word{(i * 7 + j) % 997:03}" for j in range(60))
    marked = lambda i: " ".join(f"word{(i * 7 + j) % 997:03}#" for j in range(60))
    data = [(i, plain(i), "en", "plain") for i in range(400)] + [(1000 + i, marked(i), "en", "marked") for i in range(rows)] + [(5000, marked(1), "en", "plain")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(docs, "doc_id", "text", "lang", "source").collect()}
    assert all(kept[i] for i in range(400)) and not kept[5000]
    assert all(kept[1000 + i] == (rows >= quality.LEAST_ROWS) for i in range(rows))


def test_sketches_merge(spark):
    rows = spark.range(2000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), (F.col("id") * 3 + 1).alias("word_chars"),
                                    F.lit(100).alias("n_words"), F.lit(0).alias("n_symbols"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"))
    whole = quality.quartiles(quality.sketches(rows), ["lang"])
    halves = quality.sketches(rows.where("source = 'a'")).union(quality.sketches(rows.where("source = 'b'")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, quality.quartiles(halves, ["lang"]).collect()))
    q = {r.measure: r for r in whole.collect()}["word_length"]
    assert abs(q.q1 - 1500) / 1500 < 1 / 16 and abs(q.q3 - 4500) / 4500 < 1 / 16
