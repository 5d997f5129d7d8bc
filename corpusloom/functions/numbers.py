"""Number formatting that agrees with C ``printf`` to the last digit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2**27 + 1 splits a double into two halves of 26 bits.
SPLITTER = 134217729.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _halves(x: Column) -> tuple[Column, Column]:
    scaled = x * F.lit(SPLITTER)
    high = scaled - (scaled - x)
    return high, x - high


def _rounded_units(magnitude: Column, scale: float) -> Column:
    """magnitude * scale to the nearest whole number, exact ties to the even one."""
    high, low = _halves(magnitude)
    scale_high = (scale * SPLITTER) - (scale * SPLITTER - scale)
    scale_low = scale - scale_high

    def decide(product: Column) -> Column:
        # the rounding error of the product, from the products of the halves
        error = low * F.lit(scale_low) - (
            ((product - high * F.lit(scale_high)) - low * F.lit(scale_high)) - high * F.lit(scale_low)
        )
        whole = F.floor(product)
        part = product - whole
        tie_up = (error > 0) | ((error == 0) & (whole % 2 == 1))
        return whole + ((part > 0.5) | ((part == 0.5) & tie_up)).cast("bigint")

    return _let(magnitude * F.lit(scale), decide)


#: Sizes from which the parts of a number are printed apart, and from which there is no fraction.
LARGE, LONG = 1e9, 9.0e15


def fixed(x: Column, digits: int) -> Column:
    """``%.{digits}f``: the exact binary value, rounded half to even.

    ``format_string`` rounds the printed decimal half up instead (72.25 gives
    72.3, not 72.2). The product x * 10^digits is taken with its exact rounding
    error, so a product that lands on one half is decided by the true value.
    Infinities are ``inf`` and ``-inf``; up to nine digits, exact below 2^63.
    """
    unit = 10**digits

    def number(units: Column) -> Column:
        if digits == 0:
            return units.cast("string")
        fraction = F.lpad((units % unit).cast("string"), digits, "0")
        return F.concat(F.floor(units / F.lit(unit)).cast("string"), F.lit("."), fraction)

    def text(value: Column) -> Column:
        # only the printed form tells -0.0 from 0.0
        negative = F.when(value == 0, value.cast("string").startswith("-")).otherwise(value < 0)
        sign = F.when(negative, "-").otherwise("")
        size = F.abs(value)
        small = _let(_rounded_units(F.when(size < LARGE, size).otherwise(F.lit(0.0)), float(unit)), number)
        digits_text = F.when(size < LARGE, small).when(size == float("inf"), F.lit("inf")).otherwise(_large(size))
        return F.when(F.isnan(value), F.lit("nan")).otherwise(F.concat(sign, digits_text))

    def _large(size: Column) -> Column:
        # whole and fractional part apart, or their units would not fit a long
        if digits == 0:
            return F.rint(size).cast("decimal(38,0)").cast("string")
        exact = size < LONG
        whole = F.when(exact, F.floor(F.when(exact, size).otherwise(F.lit(0.0))))
        units = _rounded_units(F.when(exact, size - whole).otherwise(F.lit(0.0)), float(unit))

        def joined(part: Column) -> Column:
            carry = (whole + (part >= unit).cast("bigint")).cast("string")
            beyond = size.cast("decimal(38,0)").cast("string")
            rest = F.lpad((part % unit).cast("string"), digits, "0")
            return F.concat(F.when(exact, carry).otherwise(beyond), F.lit("."), rest)

        return _let(units, joined)

    return _let(x.cast("double"), text)


def percent(x: Column) -> Column:
    """A share as a percentage with one decimal."""
    return fixed(x * 100, 1)


def duration(seconds: Column) -> Column:
    """``[D day(s), ]H:MM:SS``, fractions of a second cut off after rounding to microseconds."""
    micros = F.bround(seconds.cast("double") * 1000000).cast("bigint")
    whole = F.floor(micros / F.lit(1000000))
    days = F.floor(whole / F.lit(86400))
    rest = whole % 86400
    clock = F.format_string(
        "%d:%02d:%02d", F.floor(rest / F.lit(3600)), F.floor(rest % 3600 / F.lit(60)), rest % 60
    )
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))
