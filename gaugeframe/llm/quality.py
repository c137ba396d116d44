"""Quality rules whose cutoffs adapt to each language and source. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import WHITE, body, store

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BITS_KEPT = 5
LEAST_ROWS = 50
# Measure: how far beyond the middle half of its group it may lie, in widths of that half and in units; whether too little counts too.
MEASURES = {
    "word_length": (4, 200, True),  # hundredths of a character
    "symbol_share": (4, 100, False),  # per thousand words
    "dup_line_share": (4, 300, False),  # per thousand lines
    "repeat_share": (4, 150, False),  # per thousand words
}


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The base counts of every text; arrays stay within the row, so nothing is shuffled."""
    text = body(text_col)
    spaced = F.translate(text, WHITE, " " * len(WHITE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.filter(F.split(spaced, " "), lambda w: w != "").alias("words"),
    )
    count = F.size("words")
    windows = F.when(
        count >= WINDOW, F.transform(F.sequence(F.lit(1), count - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "id", "lang", "source", "word_chars", "n_symbols",
        count.cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts that repeat a window pay for the sort that finds the places.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(*[c for c in rows.columns if c != "windows"], placed.alias("placed"))
    like = lambda x, j: F.get(F.col("placed"), j)["h"] == x["h"]
    again = F.filter("placed", lambda x, i: F.coalesce(like(x, i - 1), F.lit(False)) | F.coalesce(like(x, i + 1), F.lit(False)))
    rows = rows.select(*[c for c in rows.columns if c != "placed"], F.array_sort(F.transform(again, lambda x: x["i"])).alias("starts"))
    # Words covered: a window adds what lies beyond the end of the one before.
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["sum"] + s + WINDOW - F.greatest(acc["end"], s)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return rows.select(*[c for c in rows.columns if c != "starts"], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    """Whole numbers, so that sketches and cutoffs are exact; null without words."""
    share = lambda part, whole, unit: F.expr(f"CASE WHEN {whole} > 0 THEN {unit} * {part} DIV {whole} END")
    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbol_share": share("n_symbols", "n_words", 1000),
        "dup_line_share": share("n_dup_lines", "n_lines", 1000),
        "repeat_share": share("n_repeat_words", "n_words", 1000),
    }


def rounded(value: Column) -> Column:
    """The value cut to its ``BITS_KEPT`` leading bits: the bucket of the sketch, off by less than one part in 2^(BITS_KEPT-1)."""
    drop = F.greatest(F.length(F.bin(value)) - BITS_KEPT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and bucket: sketches merge by adding the counts of a bucket."""
    values = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in measures().items()])
    long = rows.select("lang", "source", F.explode(values).alias("m")).where("m.value IS NOT NULL")
    return long.groupBy("lang", "source", "m.measure", rounded(F.col("m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, first and third quartile of each measure per group, from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # a sketch has some hundreds of buckets, whatever the rows
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    first = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("all") * part, F.col("bucket")))
    return upto.groupBy(*keys, "measure").agg(F.max("all").alias("rows"), first(1).alias("q1"), first(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Lowest and highest allowed value of each measure for every lang and source.

    A group of fewer than ``LEAST_ROWS`` rows takes the merged sketch of its language,
    or of everything if that is small too.
    """
    groups = sketch.select("lang", "source", "measure").distinct()
    levels = []
    for i, keys in enumerate((["lang", "source"], ["lang"], [])):
        q = quartiles(sketch, keys).withColumnsRenamed({"rows": "n", "measure": "m", "lang": "l", "source": "s"})
        same = [F.col("measure") == F.col("m"), *[F.col(k).eqNullSafe(F.col(k[0])) for k in keys]]
        joined = groups.join(q, reduce(lambda a, b: a & b, same))
        levels.append(joined.select("lang", "source", "measure", F.lit(i).alias("level"), "n", "q1", "q3"))
    every = reduce(DataFrame.union, levels)
    fits = (F.col("n") >= LEAST_ROWS) | (F.col("level") == 2)
    best = every.where(fits).groupBy("lang", "source", "measure").agg(F.min_by(F.struct("q1", "q3"), "level").alias("q"))
    cells = []
    for name, (times, units, both) in MEASURES.items():
        here = lambda c: F.max(F.when(F.col("measure") == name, c))
        width = (F.col("q.q3") - F.col("q.q1")) * times + units
        cells.append(here(F.col("q.q3") + width).alias(f"{name}_high"))
        if both:
            cells.append(here(F.col("q.q1") - width).alias(f"{name}_low"))
    return best.groupBy("lang", "source").agg(*cells)


def judge_quality(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Per row: id, the base counts, ``base_failed`` and ``kept``.

    A row fails the base rules with fewer than 20 words, or if more than 30 % of its words
    lie in 8-word windows that the text repeats. Other rows are kept unless a measure lies far outside the
    middle half of the rows of the same language and source (null is a value like others).
    Null texts count as empty and fail; null ids and repeated rows come out as they
    are; other columns are not read; an empty table gives none.
    """
    rows = store(features(docs, id_col, text_col, lang_col, source_col), "features")
    limits = store(thresholds(store(sketches(rows), "sketches")), "thresholds")
    same = F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    joined = rows.withColumns(measures()).alias("r").join(limits.alias("t"), same, "left")
    inside = []
    for name, (_, _, both) in MEASURES.items():
        inside.append(F.col(name) <= F.col(f"{name}_high"))
        if both:
            inside.append(F.col(name) >= F.col(f"{name}_low"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = ~failed & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(True))
    return joined.select(F.col("r.id").alias(id_col), *counts, failed.alias("base_failed"), kept.alias("kept"))
