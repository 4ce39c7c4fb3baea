"""Rounding on the exact value of a binary double, halves to even, as column expressions.

A double is m * 2**-s with a whole m below 2**55. How many units of the last wanted digit it holds, and what is left over, are
whole decimals, so no digit is ever guessed from a printed form: 2.675 lies below its half and gives 2.67, 0.125 is one and
gives 0.12.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this shift a double is under 2**-73 and has no unit of any digit wanted here.
MOST_SHIFT = 126
WIDE = "decimal(38,0)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named: the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _units(size: Column, digits: int) -> Column:
    """How many units of the last digit a finite, non-negative double below 2**63 is, to the nearest, halves to even."""
    one = F.lit(1).cast("bigint")
    power = lambda k: F.call_function("shiftleft", one, k).cast(WIDE)

    def parts(shift: Column) -> Column:
        m = (size * F.pow(F.lit(2.0), shift)).cast("bigint").cast(WIDE) * F.lit(10**digits).cast(WIDE)
        # As a decimal the power of two is made of factors below 2**63.
        by = power(F.least(shift, F.lit(62))) * power(F.greatest(F.least(shift - 62, F.lit(62)), F.lit(0))) * power(F.greatest(shift - 124, F.lit(0)))
        return F.struct(m.alias("m"), by.cast(WIDE).alias("by"))

    def nearest(p: Column) -> Column:
        return bound(p["m"] % p["by"], lambda left: bound(((p["m"] - left) / p["by"]).cast(WIDE), lambda whole: (whole + F.when((left * 2 > p["by"]) | ((left * 2 == p["by"]) & (whole % 2 == 1)), 1).otherwise(0)).cast(WIDE)))

    shift = F.greatest(F.lit(0), F.least(F.lit(MOST_SHIFT), F.lit(53) - F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))))).cast("int")
    return bound(shift, lambda k: bound(parts(k), nearest))


def fixed(x: Column, digits: int) -> Column:
    """The text of x with so many digits after the point. A value that rounds to zero keeps its sign. From 2**63 on the digits
    are those of the shortest decimal that reads back as x. Null stays null; nan, inf and -inf are written so."""
    if not 0 <= digits <= 9:
        raise ValueError("0 to 9 digits")

    def pointed(units: Column) -> Column:
        text = F.lpad(units, F.greatest(F.length(units), F.lit(digits + 1)), F.lit("0"))
        return bound(text, lambda t: F.concat(F.substring(t, F.lit(1), F.length(t) - digits), F.lit("."), F.substring(t, F.length(t) - digits + 1, F.lit(digits)))) if digits else text

    def written(v: Column) -> Column:
        size = F.abs(v)
        sound = size < 2.0**63
        sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
        small = bound(F.when(sound, size).otherwise(0.0), lambda w: bound(_units(w, digits).cast("string"), pointed))
        huge = F.concat(F.when(size < 1e38, size).otherwise(0.0).cast(WIDE).cast("string"), F.lit("." + "0" * digits if digits else ""))
        return F.when(F.isnan(v), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, F.when(sound, small).otherwise(huge)))

    return F.when(x.isNotNull(), bound(x.cast("double"), written))


def rounded(x: Column, digits: int) -> Column:
    """The double nearest to x at so many digits, halves of the exact value to even. Null, nan and infinities stay; from 2**52 on a
    double has no digits to lose."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(fixed(x, digits).cast("double"))
