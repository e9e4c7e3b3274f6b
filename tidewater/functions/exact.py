"""Exact revenue over the whole range of doubles (column functions, no UDFs).

A sale is *narrow* when its price has at most 12 decimals, its quantity is under 10^8 and its
revenue under 10^14: its revenue is then a ``MONEY`` value, and 10^11 such sales of one hour and
category sum without overflow. Every other sale of a finite price is *wide*. The price, as a
double, is ``mantissa * 10^exp10`` with an integer mantissa of at most 18 digits, and the quantity
is ``high * 10^9 + low``; the products of the mantissa with the two parts are integers, which are
summed per exponent. Integer sums do not depend on order or partitioning, and 10^10 wide sales of
one hour, category and exponent fit (beyond that the sum raises an error).

Wide sums are rounded once, when they are read: to a double, one rounding per exponent and added
in the order of the exponents, and to ``MONEY`` (null when the total does not fit the digits
before the point; 25, as an addition of decimals needs one spare digit).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY, PRICE

NARROW_QUANTITY = 10 ** 8
NARROW_REVENUE = 1e14
SUM = "decimal(37,12)"  # two of them add without losing a decimal
SPLIT = 9  # decimal digits of the low part of a quantity


def is_wide(quantity: Column, price: Column, value: Column) -> Column:
    """Whether a sale needs the wide sums: ``quantity`` long, ``price`` as ``PRICE`` (null when it
    does not fit), ``value`` the price as a double."""
    return ~F.coalesce((quantity < NARROW_QUANTITY) & (price.cast("double") == value)
                       & (quantity * value < NARROW_REVENUE), F.lit(False))


def narrow_revenue(quantity: Column, price: Column) -> Column:
    """Exact revenue of a narrow sale."""
    return (quantity.try_cast("decimal(11,0)") * price.cast(PRICE)).cast(MONEY)


def exponent(value: Column) -> Column:
    """Power of ten of the last digit of a double's shortest text."""
    text = value.cast("string")
    power = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    return power - F.length(F.substring_index(F.substring_index(text, "E", 1), ".", -1))


def mantissa(value: Column) -> Column:
    """The digits of a double's shortest text as an integer."""
    digits = F.replace(F.substring_index(value.cast("string"), "E", 1), F.lit("."), F.lit(""))
    return digits.cast("decimal(18,0)")


def wide_high(quantity: Column, value: Column) -> Column:
    """Integer in units of 10^(exp10 + 9)."""
    high = F.call_function("div", quantity, F.lit(10 ** SPLIT))
    return (mantissa(value) * high.cast("decimal(10,0)")).cast("decimal(28,0)")


def wide_low(quantity: Column, value: Column) -> Column:
    """Integer in units of 10^exp10."""
    return (mantissa(value) * (quantity % 10 ** SPLIT).cast("decimal(9,0)")).cast("decimal(28,0)")


def _term_texts(wide: Column) -> Column:
    """Array of (exp10, high, low) as decimal texts, smallest exponents first."""
    def texts(t: Column) -> Column:
        part = lambda units, e: F.struct(
            e.alias("e"), F.concat(units.cast("string"), F.lit("E"), e.cast("string")).alias("x"))
        return F.array(part(t["low"], t["exp10"]), part(t["high"], t["exp10"] + SPLIT))
    return F.transform(F.array_sort(F.flatten(F.transform(wide, texts))), lambda t: t["x"])


def total_money(narrow: Column, wide: Column) -> Column:
    """``MONEY`` total; null when it does not fit ``SUM``."""
    start = F.coalesce(narrow, F.lit(0)).try_cast(SUM)
    return F.aggregate(_term_texts(wide), start, lambda acc, x: (acc + x.try_cast(SUM)).try_cast(SUM),
                       lambda acc: acc.cast(MONEY))


def total_value(narrow: Column, wide: Column) -> Column:
    """Double total of the narrow sum and the wide ones (infinite beyond the doubles)."""
    return F.aggregate(_term_texts(wide), F.lit(0.0), lambda acc, x: acc + x.cast("double")) + \
        F.coalesce(narrow, F.lit(0)).cast("double")
