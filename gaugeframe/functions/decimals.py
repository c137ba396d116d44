"""Exact decimal digits of doubles, and their rounding half to even.

A double is a whole number times a power of two. With a negative power it is the same whole
number times a power of five, moved behind the point. Both products are worked out in limbs of
nine digits, so every digit of every finite double is there: 309 before the point, 1074 behind it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions.columns import rare

LIMB = 10**9
# The largest powers that leave room for a limb and its carry in 63 bits.
TWOS, FIVES = 32, 13


def _whole(x: Column) -> Column:
    return x.cast("bigint")


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _times(limbs: Column, factor: Column) -> Column:
    """The limbs, lowest first, times a factor that leaves room for the carry."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), _whole(F.lit(0)).alias("carry"))

    def step(state: Column, limb: Column) -> Column:
        value = limb * factor + state["carry"]
        return F.struct(F.concat(state["done"], F.array(value % LIMB)).alias("done"), _div(value, LIMB).alias("carry"))

    # A carry may be several limbs long.
    rest = lambda s: F.filter(F.array(s["carry"] % LIMB, _div(s["carry"], LIMB)), lambda limb, i: (limb > 0) | ((i == 0) & (s["carry"] > 0)))
    return F.aggregate(limbs, start, step, lambda s: F.concat(s["done"], rest(s)))


def _expanded(x: Column, power: Column) -> Column:
    """Digits of ``x`` given that it is a whole number below 2^55 times ``2^power``."""
    whole = _whole(x / F.pow(F.lit(2.0), power))
    limbs = F.array(whole % LIMB, _div(whole, LIMB))
    up = power >= 0
    size = F.abs(power)
    room = F.when(up, TWOS).otherwise(FIVES)
    base = F.when(up, 2.0).otherwise(5.0)
    rounds = F.floor(size / room).cast("int")
    factors = F.concat(F.array_repeat(_whole(F.pow(base, room)), rounds), F.array(_whole(F.pow(base, size % room))))
    product = F.aggregate(factors, limbs, _times)
    text = F.array_join(F.transform(F.reverse(product), lambda limb: F.lpad(limb.cast("string"), 9, "0")), "")
    digits = F.regexp_replace(text, "^0+", "")
    return F.struct(digits.alias("digits"), F.when(up, 0).otherwise(size).cast("int").alias("places"))


def expansion(x: Column) -> Column:
    """``(digits, places)`` of a finite double that isn't negative: exactly ``digits / 10^places``; no digits for 0."""
    exponent = F.greatest(F.floor(F.log2(F.when(x > 0, x).otherwise(1.0))) - 53, F.lit(-1074)).cast("int")
    return rare(exponent, lambda power: _expanded(x, power))


def without(digits: Column, cut: Column) -> Column:
    """The digits without the last ``cut`` ones, rounded half to even; zeros are added where ``cut`` is negative."""

    def rounded(text: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - cut)
        tail = F.substring(text, F.length(text) - cut + 1, cut)
        half = F.rpad(F.lit("5"), cut, F.lit("0"))
        odd = F.right(head, F.lit(1)).cast("int") % 2 == 1
        return F.when((tail > half) | ((tail == half) & odd), rare(head, _next)).otherwise(head)

    # A head of one zero at least, so that there is a last digit to round.
    padded = F.lpad(digits, F.greatest(F.length(digits), cut + 1), F.lit("0"))
    return F.when(cut <= 0, F.concat(digits, F.repeat(F.lit("0"), F.greatest(-cut, F.lit(0))))).otherwise(rare(padded, rounded))


def _next(digits: Column) -> Column:
    """A decimal text plus one, of any length."""
    nines = F.length(F.regexp_extract(digits, "9*$", 0))
    head = F.concat(F.lit("0"), F.substring(digits, F.lit(1), F.length(digits) - nines))
    last = (F.right(head, F.lit(1)).cast("int") + 1).cast("string")
    grown = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), last)
    # The zero in front is only kept where it grew.
    shown = F.when(nines == F.length(digits), grown).otherwise(F.substring(grown, F.lit(2), F.length(grown)))
    return F.concat(shown, F.repeat(F.lit("0"), nines))


def fixed_digits(x: Column, digits: int) -> Column:
    """A finite double that isn't negative with so many decimals."""

    def shown(number: Column) -> Column:
        units = without(number["digits"], number["places"] - digits)
        return rare(F.lpad(units, F.greatest(F.length(units), F.lit(digits + 1)), F.lit("0")), _pointed)

    def _pointed(units: Column) -> Column:
        left = F.substring(units, F.lit(1), F.length(units) - digits)
        return F.concat(left, F.lit("."), F.right(units, F.lit(digits))) if digits else left

    return rare(expansion(x), shown)


def leading_digits(x: Column, count: int) -> Column:
    """``(digits, exponent)``: the first ``count`` digits of a finite double that isn't negative, and the power of ten of the first."""
    zero = F.struct(F.lit("0" * count).alias("digits"), F.lit(0).alias("exponent"))

    def named(digits: Column, exponent: Column) -> Column:
        return F.struct(digits.alias("digits"), exponent.cast("int").alias("exponent"))

    def shown(number: Column) -> Column:
        size = F.length(number["digits"])
        kept = without(number["digits"], size - count)
        exponent = size - 1 - number["places"]
        # Rounding up may have made it a digit longer, and that digit is a zero.
        return rare(kept, lambda k: named(F.substring(k, 1, count), exponent + F.length(k) - count))

    return F.when(x == 0, zero).otherwise(rare(expansion(x), shown))
