"""Date functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from tidemark.functions.columns import as_column

# Date text of the listing and of the crossing date.
ISO_DATE = "yyyy-MM-dd"
LONG_DATE = "EEE MMM dd yyyy"


def day_of(when: Column | str) -> Column:
    """Truncate a date or time stamp to its day."""
    return F.to_date(as_column(when))


def iso_date(day: Column | str) -> Column:
    """Date as ``yyyy-MM-dd`` text."""
    return F.date_format(as_column(day), ISO_DATE)


def long_date(day: Column | str) -> Column:
    """Date as text such as ``Wed Mar 08 2023``."""
    return F.date_format(as_column(day), LONG_DATE)


def add_days(day: Column | str, days: Column | str | int) -> Column:
    """Move a date by whole days."""
    return F.date_add(as_column(day), as_column(days).cast("int"))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from ``start`` to ``end`` as bigint."""
    return F.datediff(as_column(end), as_column(start)).cast("bigint")


def date_series(first: Column | str, last: Column | str, step: str = "1 day") -> Column:
    """Array of dates from ``first`` to ``last``, both ends included.

    Null when a bound is null or the bounds are crossed, so that ``explode``
    yields no row.
    """
    lo, hi = as_column(first), as_column(last)
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval {step}")))
