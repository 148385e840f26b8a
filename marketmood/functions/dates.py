"""Date/time column functions (D-1 .. D-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A time of day that is followed by an offset or zone mark.
_WITH_OFFSET = r":[0-9]{2}(\.[0-9]+)?\s*(Z|UTC|[+-][0-9]{1,2}(:?[0-9]{2})?)$"
_DATE_ONLY = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$"


def parse_utc(c) -> Column:
    """D-1: the instant (TIMESTAMP) of a string with or without a UTC offset.

    Strings without an offset are UTC, whatever the session zone. Unparseable
    strings become NULL instead of failing the job.
    """
    x = F.trim(_c(c))
    with_zone = (F.when(x.rlike(_WITH_OFFSET), x).when(x.rlike(_DATE_ONLY), F.concat(x, F.lit(" 00:00:00Z")))
                 .otherwise(F.concat(x, F.lit("Z"))))
    return F.try_to_timestamp(with_zone)


def parse_date(c, fmt: str | None = None) -> Column:
    """D-2: parse naive date strings (NULL on failure)."""
    x = _c(c)
    if fmt:
        return F.try_to_timestamp(x, F.lit(fmt)).cast("date")
    return F.to_date(F.try_to_timestamp(x))


def day(c) -> Column:
    """D-3: calendar day of a date or a timestamp without zone."""
    return F.to_date(_c(c))


def utc_day(c) -> Column:
    """D-3 for instants (TIMESTAMP with zone): the UTC calendar day, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(_c(c)) / F.lit(86400)).cast("int"))


def day_of(df: DataFrame, c: str) -> Column:
    """D-3 by the column's type: the UTC day of an instant, else the calendar day as written."""
    return utc_day(c) if isinstance(df.schema[c].dataType, T.TimestampType) else day(c)


def format_day(c) -> Column:
    """D-4: ``yyyy-MM-dd`` text."""
    return F.date_format(_c(c), "yyyy-MM-dd")
