"""Text at scale: placeholders, markup to LaTeX, escapes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.columns import col, cols, variant_text

PLACEHOLDER = r"@\{([^}]+)\}@"
CONFIG_PLACEHOLDER = r"\{\{([^{}]+)\}\}"


def replace_tokens(text: Column, pattern: str, replacement) -> Column:
    """Replace every match of the pattern by ``replacement(group 1, whole match)``, in order."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    filled = F.transform(inner, lambda token, i: F.concat(replacement(token, F.get(whole, i)), F.get(between, i + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(filled, ""))


def _json_path(path: Column, indexed: bool) -> Column:
    quoted = lambda part: F.concat(F.lit('["'), part, F.lit('"]'))
    step = lambda part: F.when(part.rlike(r"^\d+$"), F.concat(F.lit("["), part, F.lit("]"))).otherwise(quoted(part))
    parts = F.transform(F.split(path, r"\."), step if indexed else quoted)
    return F.concat(F.lit("$"), F.array_join(parts, ""))


def look_up(data: Column, path: Column) -> Column:
    """Variant at ``a.b.0``: a number is a position in a list and a name in an object; null if absent."""
    safe = F.when(~path.contains('"') & ~path.rlike(r"(^|\.)(\.|$)"), path)
    return F.coalesce(
        F.try_variant_get(data, _json_path(safe, True), "variant"),
        F.try_variant_get(data, _json_path(safe, False), "variant"),
    )


def _shown(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "VOID", "None").otherwise(variant_text(value))


def _variant_length(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("ARRAY<"), F.size(F.try_variant_get(value, "$", "array<variant>")))
        .when(kind.startswith("OBJECT<"), F.size(F.try_variant_get(value, "$", "map<string,variant>")))
        .when(kind == "STRING", F.length(F.try_variant_get(value, "$", "string")))
    )


def fill_text(text: str | Column, data: Column, pattern: str = PLACEHOLDER) -> Column:
    """Fill ``@{a.b.0}@`` and ``@{a.b | length}@`` from a variant of the same row.

    A path the data lacks stays as written; an unknown operation is ignored. The
    paths of a fixed text are known to the plan; those of a text column are made
    row by row.
    """
    if isinstance(text, str):
        return _fill_fixed(text, data, pattern)

    def value_of(token, whole):
        parts = F.transform(F.split(token, r"\|"), lambda p: F.trim(p))
        path = F.when(token.contains("|"), F.get(parts, F.lit(0))).otherwise(token)
        value = look_up(data, path)
        counted = F.array_contains(F.slice(parts, F.lit(2), F.size(parts)), "length")
        shown = F.when(counted, _variant_length(value).cast("string")).otherwise(_shown(value))
        return F.coalesce(shown, whole)

    return replace_tokens(text, pattern, value_of)


def _fill_fixed(text: str, data: Column, pattern: str) -> Column:
    pieces, end = [], 0
    for match in re.finditer(pattern, text):
        path, *operations = [p.strip() for p in match[1].split("|")] if "|" in match[1] else [match[1]]
        parts = path.split(".")
        value = F.lit(None).cast("string")
        if '"' not in path and all(parts):
            named = "".join(f'["{p}"]' for p in parts)
            placed = "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' for p in parts)
            found = F.try_variant_get(data, f"${placed}", "variant")
            if placed != named:
                found = F.coalesce(found, F.try_variant_get(data, f"${named}", "variant"))
            value = _variant_length(found).cast("string") if "length" in operations else _shown(found)
        pieces += [F.lit(text[end : match.start()]), F.coalesce(value, F.lit(match[0]))]
        end = match.end()
    return F.concat(*pieces, F.lit(text[end:]))


def fill_config(df: DataFrame, target: str, lookup: str, pattern: str = CONFIG_PLACEHOLDER) -> DataFrame:
    """Fill ``{{a.b}}`` from a map column, innermost first, so that names may be built from values.

    Chains may have any length: every row goes on until nothing changes. Unknown names
    stay as written, and so do names whose value leads back to themselves. A text that
    still runs in a circle, through names built from values, is left unchanged. The pattern
    is Python's: the rows are filled by a small function on Arrow batches, as a chain of
    names in built-ins takes a pass of every expression for each of its links.
    """
    nothing = F.array().cast("array<string>")
    named = F.transform_keys(F.coalesce(col(lookup), F.map_from_arrays(nothing, nothing)), lambda k, v: F.trim(k))

    def fill(texts: pa.Array, maps: pa.Array) -> pa.Array:
        found, ends = re.compile(pattern), maps.offsets.to_pylist()
        rows, keys, values = (a.to_numpy(zero_copy_only=False).tolist() for a in (texts, maps.keys, maps.items))
        return pa.array([_filled(t, dict(zip(keys[a:b], values[a:b])), found) for t, a, b in zip(rows, ends, ends[1:])], pa.string())

    return df.withColumn(target, F.arrow_udf(fill, "string")(col(target).cast("string"), named))


def _filled(text: str | None, names: dict[str, str | None], found: re.Pattern) -> str | None:
    """The text of one row with its names filled, all of them at once in each turn until nothing changes."""
    if text is None or not found.search(text):
        return text
    circles = _circles(names, found)
    known = {k: v for k, v in names.items() if k not in circles}
    hit = False

    def value_of(match: re.Match) -> str:
        nonlocal hit
        name = (match[1] or "").strip(" ")
        if name not in known:
            return match[0]
        hit = True
        return match[0] if known[name] is None else known[name]

    # A chain is no longer than the names there are, for each level of nested names.
    filled, turn, most = text, 0, len(names) + 1
    while True:
        hit = False
        after = found.sub(value_of, filled)
        if not hit:
            return filled
        if turn == most:
            every = " ".join([text, *(v for v in names.values() if v is not None)])
            most = (len(names) + 1) * (len(found.findall(every)) + 1) + 1
            if turn == most:
                return text
        filled, turn = after, turn + 1


def _circles(names: dict[str, str | None], found: re.Pattern) -> set[str]:
    """The names that lead back to themselves."""
    first = (lambda groups: groups[0]) if found.groups > 1 else (lambda group: group)
    leads = {k: {first(g).strip(" ") for g in inner} for k, v in names.items() if v and (inner := found.findall(v))}
    # Names that lead to no such name are taken out one after the other; what is left runs in circles or into them.
    open_ = {k: sum(n in leads for n in direct) for k, direct in leads.items()}
    back: dict[str, list[str]] = {}
    for k, direct in leads.items():
        for n in direct:
            back.setdefault(n, []).append(k)
    done = [k for k, n in open_.items() if not n]
    while done:
        k = done.pop()
        del open_[k]
        for p in back.get(k, ()):
            open_[p] -= 1
            if not open_[p]:
                done.append(p)

    def returns(name: str) -> bool:
        seen, ahead = set(), [name]
        while ahead:
            for n in leads[ahead.pop()]:
                if n == name:
                    return True
                if n in open_ and n not in seen:
                    seen.add(n)
                    ahead.append(n)
        return False

    return {k for k in open_ if returns(k)}


def path_map(flat: DataFrame, keys: list[str], name: str = "lookup") -> DataFrame:
    """``(path, value)`` rows of each document as one map per document."""
    entry = F.struct("path", F.coalesce("value", F.lit("None")))
    return flat.groupBy(*cols(keys)).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def markup_to_latex(text: Column) -> Column:
    """Comment signs, formulas, bold, links and cross references to LaTeX."""
    text = F.replace(text, F.lit("%"), F.lit("\\%"))
    rules = [
        (r"stem:\[\s*(.*?)\s*\]", r"\$$1\$"),
        (r"(?<![A-Za-z0-9])\*(.+?)\*(?![A-Za-z0-9])", r"\\textbf{$1}"),
        (r"([a-zA-Z][a-zA-Z0-9+.-]*:[^\s\[]+?)\[\s*\]", r"\\url{$1}"),
        (r"([a-zA-Z][a-zA-Z0-9+.-]*:[^\s\[]+?)\[\s*(.*?)\s*\]", r"\\href{$1}{$2}"),
        (r"<<\s*([^\s,>]+)\s*,\s*([^>]+)>>", r"\\hyperlink{$1}{$2}"),
        (r"<<\s*([^\s,>]+)\s*,?\s*>>", r"\\ref{$1}"),
    ]
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


# Fixed values, in the order they are applied: the backslash goes first.
LATEX_ESCAPES = [
    ("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("#", "\\#"), ("$", "\\$"), ("%", "\\%"),
    ("&", "\\&"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\^{}"),
]


def latex_escape(text: Column) -> Column:
    """Special characters of a LaTeX table cell."""
    for char, escaped in LATEX_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return text
