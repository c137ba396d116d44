"""Scalar functions: printf formats, value maps, names, dates, durations."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.columns import col, data_type, python_text, rare
from gaugeframe.functions.decimals import fixed_digits, leading_digits

_FORMAT = re.compile(r"^((?:[^%]|%%)*)%([-+ 0#]*)(\d*)(?:\.(\d+))?([a-zA-Z])((?:[^%]|%%)*)$")
_NUMERIC = (T.NumericType, T.BooleanType)
# Up to so many digits the built-in format is exact wherever the next three are not next to a half step.
BUILT_IN_DIGITS = 11


def fixed(value: Column, digits: int) -> Column:
    """``%.<digits>f`` as Python prints it: the exact binary value, ties to even.

    The built-in format rounds the shortest decimal form half up (2.25 gives 2.3,
    1.005 gives 1.01). It is right unless the value is next to a half step or so
    large that steps blur, and those cases are worked out exactly.
    """
    x = value.cast("double")
    if digits > BUILT_IN_DIGITS:
        return rare(x, lambda v: _signed(v, lambda size: fixed_digits(size, digits)))
    near = lambda size: F.when(size < 2.0**52, _near_half(size, digits)).otherwise(fixed_digits(size, digits))
    exact = rare(x, lambda v: _signed(v, near))
    scaled = F.abs(x) * F.lit(10.0**digits)
    clear = (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > 1e-4) & (scaled < 1e11)
    return F.when(clear, F.format_string(f"%.{digits}f", x)).otherwise(exact)


def _product_error(x: Column, factor: float, product: Column) -> Column:
    """What rounding took from ``x * factor``: halves of 26 bits multiply exactly."""
    def halves(v):
        wide = v * F.lit(134217729.0)
        high = wide - (wide - v)
        return high, v - high

    xh, xl = halves(x)
    fh, fl = halves(F.lit(factor))
    return ((xh * fh - product) + xh * fl + xl * fh) + xl * fl


def _near_half(x: Column, digits: int) -> Column:
    """A number below 2^52, whole part and fraction apart, as both are exact.

    The product of the fraction with 10^digits is compared with the half step, and
    where it seems to sit on it its rounding error decides. Much quicker than all digits.
    """
    part = x - F.floor(x).cast("double")
    scaled = part * F.lit(10.0**digits)
    low = F.floor(scaled).cast("double")
    half = (scaled - low) - F.lit(0.5)
    error = _product_error(part, 10.0**digits, scaled)
    odd = F.pmod(low, F.lit(2.0)) == 1 if digits else F.pmod(F.floor(x), F.lit(2)) == 1
    up = (half > 0) | ((half == 0) & ((error > 0) | ((error == 0) & odd)))
    units = (low + F.when(up, 1.0).otherwise(0.0)).cast("bigint")
    over = units >= 10**digits
    left = (F.floor(x) + F.when(over, 1).otherwise(0)).cast("string")
    right = F.lpad(F.when(over, units - 10**digits).otherwise(units).cast("string"), digits, "0")
    return F.concat(left, F.lit("."), right) if digits else left


def _signed(value: Column, shown: Callable[[Column], Column]) -> Column:
    """``shown`` of the size of a double behind its sign; ``nan``, ``inf`` and ``-inf`` by name."""
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    size = F.abs(value)
    named = F.when(F.isnan(value), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf")))
    return named.when(value.isNotNull(), F.concat(sign, shown(size)))


def scientific(value: Column, digits: int) -> Column:
    """``%.<digits>e`` as Python prints it, by the exact binary value.

    The built-in format is right unless the three digits after the last one are next to
    a half step; then, and for more digits than it has, the value is worked out.
    """
    x = value.cast("double")
    exact = rare(x, lambda v: _signed(v, lambda size: rare(leading_digits(size, digits + 1), _with_exponent)))
    if digits > BUILT_IN_DIGITS:
        return exact
    next_three = F.right(F.substring_index(F.format_string(f"%.{digits + 3}e", x), "e", 1), F.lit(3)).try_cast("int")
    # Below 2^-1022 doubles have fewer digits than they are printed with.
    clear = (F.abs(next_three - 500) > 2) & ((F.abs(x) >= 2.0**-1022) | (x == 0))
    return F.when(clear, F.format_string(f"%.{digits}e", x)).otherwise(exact)


def _with_exponent(number: Column) -> Column:
    first, rest = F.substring(number["digits"], 1, 1), F.substring(number["digits"], 2, 2**31 - 1)
    mantissa = F.when(rest == "", first).otherwise(F.concat(first, F.lit("."), rest))
    return F.concat(mantissa, _exponent_text(number["exponent"]))


def _exponent_text(exponent: Column) -> Column:
    size = F.abs(exponent).cast("string")
    return F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))


def general(value: Column, digits: int, keep_zeros: bool = False) -> Column:
    """``%.<digits>g``: fixed between 1e-4 and 10^digits, else an exponent; no trailing zeros unless kept.

    Both layouts show the digits that ``%e`` rounds to.
    """
    count = max(digits, 1)
    return rare(scientific(value, count - 1), lambda text: _laid_out(text, count, keep_zeros))


def _laid_out(text: Column, count: int, keep_zeros: bool) -> Column:
    sign = F.when(text.startswith("-"), "-").otherwise("")
    exponent = F.regexp_extract(text, r"e([-+]\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(text, "e", 1), r"[-.]", "")
    whole = F.when(exponent >= 0, F.substring(digits, F.lit(1), exponent + 1)).otherwise("0")
    behind = F.when(exponent >= 0, F.substring(digits, exponent + 2, F.lit(count)))
    behind = behind.otherwise(F.concat(F.repeat(F.lit("0"), -exponent - 1), digits))
    strip = lambda t: t if keep_zeros else F.regexp_replace(t, r"\.?0*$", "")
    plain = strip(F.concat(whole, F.lit("."), behind))
    powered = F.concat(strip(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, count))), _exponent_text(exponent))
    shown = F.when((exponent >= -4) & (exponent < count), plain).otherwise(powered)
    return F.when(exponent.isNull(), text).otherwise(F.concat(sign, shown))  # nan and inf have no exponent


def printf(value: Column, dtype: T.DataType, template: str) -> Column:
    """``template % value`` for a template with one conversion.

    A conversion the type does not fit gives the value's text, as does a template
    Python would reject; a null number prints as ``nan``.
    """
    text = python_text(value, dtype)
    match = _FORMAT.match(template)
    if not match:
        return text
    before, flags, width, precision, kind, after = match.groups()
    digits = 6 if precision is None else int(precision)
    numeric = isinstance(dtype, _NUMERIC)
    if kind == "s":
        body = text if precision is None else F.substring(text, 1, digits)
    elif not numeric or kind not in "dieEfFgG":
        return text
    else:
        number = value.cast("int") if isinstance(dtype, T.BooleanType) else value
        double = number.cast("double")
        if kind in "di":
            whole = F.when(double < 0, F.ceil(number)).otherwise(F.floor(number)).cast("string")
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                # A double past 2^53 is whole, and it may be more than a bigint holds.
                body = F.when(F.abs(double) < 2.0**53, whole).otherwise(fixed(double, 0))
            else:
                body = whole
        elif kind in "fF":
            body = fixed(double, digits)
        elif kind in "gG":
            body = general(double, digits, "#" in flags)
        else:
            body = scientific(double, digits)
        if "#" in flags and kind in "eEfF" and digits == 0:
            body = F.regexp_replace(body, r"^(-?\d+)", "$1.")
        body = F.upper(body) if kind.isupper() else body
        if "+" in flags or " " in flags:
            sign = "+" if "+" in flags else " "
            body = F.when(body.startswith("-"), body).otherwise(F.concat(F.lit(sign), body))
        body = F.coalesce(body, F.lit("nan"))
    if width:
        size = F.greatest(F.length(body), F.lit(int(width)))
        if "-" in flags:
            body = F.rpad(body, size, F.lit(" "))
        elif "0" in flags and kind != "s":
            sign = F.regexp_extract(body, "^[-+ ]?", 0)
            rest = F.substring(body, F.length(sign) + 1, F.length(body))
            body = F.concat(sign, F.lpad(rest, size - F.length(sign), F.lit("0")))  # also nan and inf, as Python does
        else:
            body = F.lpad(body, size, F.lit(" "))
    return F.concat(F.lit(before.replace("%%", "%")), body, F.lit(after.replace("%%", "%")))


def value_map(value: Column, dtype: T.DataType, labels: Mapping[str, str]) -> Column:
    """Label of the value's text, or the text itself."""
    text = python_text(value, dtype)
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(lookup[text], text)


def _whole_number_column(df: DataFrame, name: str, template: str) -> bool:
    match = _FORMAT.match(template)
    return bool(match) and match[5] in "di" and isinstance(data_type(df, name), _NUMERIC)


def _not_whole(df: DataFrame, name: str) -> Column:
    """1 for a cell that ``%d`` can't print: null, nan, infinite."""
    value, dtype = col(name), data_type(df, name)
    bad = value.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = bad | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.max(bad.cast("int"))


def _cell_text(df: DataFrame, name: str) -> Column:
    """Text of a cell of a column with gaps: numbers are doubles there, and a flag that is missing is ``None``."""
    value, dtype = col(name), data_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(python_text(value, dtype), F.lit("None"))
    return F.coalesce(python_text(value.cast("double"), T.DoubleType()), F.lit("nan"))


def format_columns(df: DataFrame, formats: Mapping[str, str | Mapping[str, str]]) -> DataFrame:
    """printf template or value map per column; names the table lacks are skipped. Results are texts.

    One cell that ``%d`` can't print (null, nan, infinite) makes the whole column plain texts; all such
    columns are looked through in one pass.
    """
    whole = [n for n, rule in formats.items() if n in df.columns and isinstance(rule, str) and _whole_number_column(df, n, rule)]
    broken = df.agg(F.struct(*[_not_whole(df, n).alias(f"c{i}") for i, n in enumerate(whole)])).scalar() if whole else None
    made = {}
    for name, rule in formats.items():
        if name in df.columns:
            apply = printf if isinstance(rule, str) else value_map
            made[name] = apply(col(name), data_type(df, name), rule)
            if name in whole:
                has_gap = broken[f"c{whole.index(name)}"] == 1
                made[name] = F.when(has_gap, _cell_text(df, name)).otherwise(made[name])
    return df.withColumns(made) if made else df


def sanitize(text: Column) -> Column:
    """File-name form: blanks become ``-``; letters, digits, ``_``, ``-`` and ``.`` stay."""
    return F.regexp_replace(F.translate(text, " ", "-"), r"[^\p{L}\p{N}_.\-]", "")


def _initcap(text: Column) -> Column:
    """Capital after every blank; the one small letter whose capital is two letters gives ``Ss``."""
    return F.regexp_replace(F.initcap(text), "(^| )ß", "$1Ss")


def title_label(text: Column) -> Column:
    """Title case that starts over at every character that is no letter: ``num_cases`` to ``Num_Cases``."""
    mark = "\x01 "
    marked = F.regexp_replace(text, r"([^\p{L} ])(?=\p{L})", "$1" + mark)
    return F.replace(_initcap(marked), F.lit(mark), F.lit(""))


def split_part(text: Column, separator: str, index: int) -> Column:
    """Part of a text by position; null when there is none."""
    return F.get(F.split(text, F.lit("\\Q" + separator + "\\E")), F.lit(index))


def leaf_date(text: Column) -> Column:
    """Date of a leaf named ``2024_05_01T10_20_30``; null for another name."""
    return F.try_to_timestamp(text, F.lit("yyyy_MM_dd'T'HH_mm_ss"))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``days-hours:minutes:seconds``; null when a part is missing or out of range."""
    pattern = r"^(\d+)-(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    days, hours, minutes, seconds = (F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2, 3, 4))
    valid = (hours < 24) & (minutes < 60) & (seconds < 60)
    return F.when(valid, ((days * 24 + hours) * 60 + minutes) * 60 + seconds)


def strip_quotes(text: Column) -> Column:
    """Double quotes off both ends."""
    return F.regexp_replace(text, '^"+|"+$', "")


def upper_case(text: Column) -> Column:
    return F.upper(text)


def strip_newlines(text: Column) -> Column:
    """Line ends become blanks; outer white space goes."""
    return F.regexp_replace(F.translate(text, "\n", " "), r"^\s+|\s+$", "")


def capitalise_words(text: Column) -> Column:
    """Words with a capital first letter, joined by single blanks."""
    return _initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))
