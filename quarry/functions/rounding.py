"""Rounding of a double's exact binary value, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest power of two by which a value is scaled: what is smaller than 2 ** -66 rounds to 0 at the digits allowed here.
MOST = 120
#: Values from which decimals are used: below, ten thousand times the value has a whole part that doubles hold.
FINE = float(2**36)


def half_even(x: Column, digits: int = 0) -> Column:
    """A double rounded to 0 to 4 digits by its exact value: 2.675, which is a little less in binary, gives 2.67, and 0.125 gives 0.12.

    Spark's own functions round the shortest decimal that prints as the double. Here the value is a whole number over a power
    of two, both exact decimals, and the remainder of their division is compared with one half. Nulls, NaN and infinities
    stay; the sign of zero isn't kept. Values below FINE are rounded by doubles alone, whose products and remainders are exact here.
    """
    if not 0 <= digits <= 4:
        raise ValueError("digits must be 0 to 4")
    a = F.abs(x)
    fine = (a > 0) & (a < float(2**53))
    small = F.when(a < FINE, _by_doubles(a, digits)).otherwise(_by_decimals(a, digits))
    return F.when(fine, F.when(x < 0, -small).otherwise(small)).otherwise(x)


def _by_doubles(a: Column, digits: int) -> Column:
    """The same of a positive double below FINE: its first 24 bits and the others times the power of ten are exact, and so are their
    whole parts and the rest of each; the sum of the rests is one double and what it lacks."""
    power = float(10**digits)
    high = a.cast("float").cast("double")
    first, second = high * power, (a - high) * power
    whole = [F.floor(c).cast("double") for c in (first, second)]
    f, g = first - whole[0], second - whole[1]
    base, rest = whole[0] + whole[1], f + g
    lack = (f - (rest - (rest - f))) + (g - (rest - f))
    odd = F.pmod(base.cast("long"), F.lit(2)) == 1
    tie = lambda down: F.when(lack < 0, False).when(lack > 0, True).otherwise(down)
    up = F.when(rest == 0.5, tie(odd).cast("int")).when(rest == 1.5, 1 + tie(~odd).cast("int")).otherwise(F.when(rest < 0.5, 0).when(rest < 1.5, 1).otherwise(2))
    return (base + up) / power


def _by_decimals(a: Column, digits: int) -> Column:
    # two bits more than a double has, so that a logarithm that is off by one does no harm
    k = F.greatest(F.lit(0), 54 - F.floor(F.log2(a))).cast("int")
    whole = (a * F.pow(F.lit(2.0), k.cast("double"))).cast("long").cast("decimal(19,0)")
    half = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(19,0)")
    k1 = F.floor(k / 2).cast("int")
    power = (half(k1) * half(k - k1)).cast("decimal(38,0)")
    value = (whole * F.lit(10**digits).cast("decimal(5,0)")).cast("decimal(38,0)")
    rest = value % power
    quotient = ((value - rest) / power).cast("decimal(38,0)")
    up = (rest * 2 > power) | ((rest * 2 == power) & (quotient % 2 == 1))
    rounded = quotient + F.when(up, 1).otherwise(0).cast("decimal(1,0)")
    decimal = F.concat(rounded.cast("string"), F.lit(f"E-{digits}")).cast("double")
    return F.when(k <= MOST, decimal).otherwise(0.0)
