"""Column functions that turn raw text into typed values (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PRICE

# The two accepted sale-stamp layouts are "date T time" with an optional
# fraction of up to nine digits, no zone suffix.
SALE_TS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]"
DATE_PATTERN = "yyyy-MM-dd"
INT_TEXT = r"^[+-]?[0-9]+$"
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_int(text: Column) -> Column:
    """Strict integer parse: null unless the whole text is an integer literal.

    Spark's cast trims blanks, the reference's parser does not, hence the pattern guard.
    """
    return F.when(text.rlike(INT_TEXT), text.try_cast("long"))


def parse_price(text: Column) -> Column:
    """Exact price (``PRICE``); NaN, Inf, blanks and overflow become null."""
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast(PRICE))


def parse_double(text: Column) -> Column:
    """The value as a double, for the sign and size of prices that ``PRICE`` would round."""
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def parse_sale_ts(text: Column) -> Column:
    """ISO local stamp without zone, optional fraction; anything else is null."""
    return F.try_to_timestamp(text, F.lit(SALE_TS_PATTERN)).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    """Strict yyyy-MM-dd date; null when it does not parse."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
                  F.try_to_timestamp(text, F.lit(DATE_PATTERN)).cast("date"))


def hour_of(ts: Column) -> Column:
    """Truncate to the hour and keep the zone-less type."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")
