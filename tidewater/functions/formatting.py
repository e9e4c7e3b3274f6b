"""Text formatting of dates, stamps and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.date_format(c, "yyyy-MM-dd")


def rfc3339(c: Column) -> Column:
    """RFC 3339 in UTC (``...Z``), as the gateway formats stamps."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def empty_if_null(c: Column) -> Column:
    """A NULL text becomes the empty string."""
    return F.coalesce(c, F.lit(""))


def timedelta_text(seconds: Column) -> Column:
    """A duration in the text form of a pandas Timedelta: ``N days HH:MM:SS``."""
    s = seconds.cast("long")
    days = F.floor(s / 86400).cast("long")
    rem = s - days * 86400
    return F.format_string("%d days %02d:%02d:%02d", days, F.floor(rem / 3600).cast("int"),
                           F.floor((rem % 3600) / 60).cast("int"), (rem % 60).cast("int"))
