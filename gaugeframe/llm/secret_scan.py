"""Secret scans by a trigram index. DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that a match
must hold. Postings of these trigrams are intersected, and only rows that fit are
searched with the expression; rules without mandatory trigrams search every row.
"""

from __future__ import annotations

import re._constants as sre
import re._parser
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import body, numbered, store, unused

MOST_STRINGS = 64


class Rule(NamedTuple):
    """A kind of secret; ``least`` characters are asked of ``group`` (0 is the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed values. A run of 24 or more hex digits is the same as a run of any length that is dropped if shorter;
# so is a key of 20 or more characters, as a later start within the same run is shorter still.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
]

Query = list[list[frozenset[str]]]  # all clauses hold; of a clause's sets one has all its trigrams in the text


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """What lower-cased texts with a match must hold.

    A stretch of the expression with few spellings becomes a clause, with one set of
    trigrams for each spelling; whatever has many spellings ends the stretch. A clause
    with a spelling of fewer than three characters asks for nothing and is left out; so is
    a spelling that asks for more than another one does.
    """
    clauses: Query = []

    def close(spellings: list[str]) -> None:
        sets = [_grams(s.lower()) for s in spellings]
        if sets and all(sets):
            clauses.append([s for s in dict.fromkeys(sets) if not any(t < s for t in sets)])

    def spell(tree) -> list[str] | None:
        """All spellings of a part, or None if there are too many or no end of them."""
        out = [""]
        for kind, value in tree:
            here = one(kind, value)
            if here is None or len(here) * len(out) > MOST_STRINGS:
                return None
            out = [a + b for a, b in product(out, here)]
        return out

    def one(kind, value) -> list[str] | None:
        if kind is sre.LITERAL:
            return [chr(value)]
        if kind is sre.SUBPATTERN:
            return spell(value[3])
        if kind is sre.BRANCH:
            parts = [spell(b) for b in value[1]]
            return None if None in parts else [s for p in parts for s in p]
        if kind is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= 8:
            return [chr(v) for _, v in value]
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
            part = spell(value[2])
            return None if part is None else [s for n in range(value[0], value[1] + 1) for s in map("".join, product(part, repeat=n))]
        return None

    open_ = [""]
    for kind, value in re._parser.parse(pattern):
        here = one(kind, value)
        if here is None or len(here) * len(open_) > MOST_STRINGS:
            close(open_)
            open_ = here if here is not None else [""]
        else:
            open_ = [a + b for a, b in product(open_, here)]
    close(open_)
    return clauses


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """A row (gram, rid) for each wanted trigram that a lower-cased text holds."""
    low = rows.select("rid", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    return low.select("rid", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """The rows in the intersected postings of each rule: rid and the kinds to search for."""
    grams = F.collect_set("gram")  # at most all wanted trigrams, whatever the text
    held = index.groupBy("rid").agg(grams.alias("grams"))
    has = lambda s: reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in sorted(s)])
    clause = lambda c: reduce(lambda a, b: a | b, map(has, c))
    fits = [F.when(reduce(lambda a, b: a & b, map(clause, q)), F.lit(kind)) for kind, q in queries.items()]
    return held.select("rid", F.array_compact(F.array(*fits)).alias("kinds")).where(F.size("kinds") > 0)


def _matches(rule: Rule, text: Column) -> Column:
    """Per match the length of the text before it since the last one, its own and its group's."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    size = lambda a: F.transform(a, lambda x: F.length(x))
    zipped = F.zip_with(F.zip_with(size(between), size(found), lambda g, m: F.struct(g.alias("gap"), m.alias("own"))), size(group),
                        lambda s, l: F.struct(s["gap"].alias("gap"), s["own"].alias("own"), l.alias("part")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.filter(zipped, lambda s: s["own"].isNotNull()))


def _numbered(hits: Column, number: int) -> Column:
    return F.transform(hits, lambda s, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), s["gap"], s["own"], s["part"]))


def find_spans(docs: DataFrame, id_col: str, text_col: str, rules: list[Rule]) -> DataFrame:
    """Per row: id and ``found``, the (start, kind number, end) of every match in order.

    Starts and ends count code points, the end is exclusive; matches of a kind are
    leftmost and do not overlap. Null counts as empty; null ids and repeated rows come
    out as they are; other columns are not read; an empty table gives none. ``docs``
    is read once.
    """
    stored, rid = numbered(docs.select(id_col, text_col))
    return _spans(stored, rid, id_col, text_col, rules).select(F.col("id").alias(id_col), "found")


def _spans(docs: DataFrame, rid: str, id_col: str, text_col: str, rules: list[Rule]) -> DataFrame:
    """:func:`find_spans` of numbered rows, with the number as ``rid`` and the id as ``id``."""
    rows = docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), body(text_col).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    searched = rows.select("rid", "text")
    if queries:
        grams = sorted({g for q in queries.values() for c in q for s in c for g in s})
        chosen = store(candidates(postings(rows, grams), queries), "candidates")
        searched = searched.join(chosen, "rid", "left")
    parts = []
    for number, rule in enumerate(rules):
        wanted = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True)
        hits = F.when(F.coalesce(wanted, F.lit(False)), _matches(rule, F.col("text")))
        parts.append(_numbered(hits, number))
    kind = "array<struct<kind:int,i:int,gap:int,own:int,part:int>>"
    every = F.flatten(F.array(*[F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts]))
    matches = store(searched.select("rid", F.explode(every).alias("m")).select("rid", "m.*"), "matches")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = matches.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(before).cast("bigint"))
    least = F.coalesce(*[F.when(F.col("kind") == i, F.lit(r.least)) for i, r in enumerate(rules)])
    good = ends.where(F.col("part") >= least).select("rid", F.struct((F.col("end") - F.col("own")).alias("start"), "kind", "end").alias("span"))
    spans = good.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("found"))  # bounded by the text
    joined = rows.select("rid", "id").join(spans, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return joined.select("rid", "id", F.coalesce("found", none).alias("found"))


def spelled(found: Column, rules: list[Rule]) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str, text_col: str, rules: list[Rule], mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; each run of overlapping spans in a text is replaced by ``mark``."""
    stored, rid = numbered(docs)
    found = unused(stored, "found")
    spans = _spans(stored, rid, id_col, text_col, rules).where(F.size("found") > 0).select(F.col("rid").alias(rid), F.col("found").alias(found))
    text = F.col(text_col)
    kind = "struct<at:bigint,out:string>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # A span that starts in the last one only lengthens what is left out.
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out")).cast(kind)

    # The rest of the text is as long as the text at most.
    finish = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    cleaned = F.when(F.col(found).isNull(), text).otherwise(F.aggregate(found, begin, step, finish))
    joined = stored.join(spans, rid, "left")
    return joined.withColumn(text_col, cleaned).select(*docs.columns)
