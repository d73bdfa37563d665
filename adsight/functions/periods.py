"""Date windows as Column expressions: inclusive (start, end) pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from adsight.functions.kpi import col

Day = Column | str | dt.date


def day(value: Day) -> Column:
    """A date literal for a Python date, otherwise the column itself."""
    return F.lit(value) if isinstance(value, dt.date) else col(value)


def trailing(end: Day, days: int) -> tuple[Column, Column]:
    return F.date_sub(day(end), days - 1), day(end)


def previous(start: Day, end: Day) -> tuple[Column, Column]:
    length = F.datediff(day(end), day(start)) + 1
    return F.date_sub(day(start), length), F.date_sub(day(start), 1)


def month_to_date(end: Day) -> tuple[Column, Column]:
    return F.trunc(day(end), "MM"), day(end)


def between(column: Column | str, start: Day, end: Day) -> Column:
    return col(column).between(day(start), day(end))


def overlaps(a_start: Day, a_end: Day, b_start: Day, b_end: Day) -> Column:
    return (day(a_start) <= day(b_end)) & (day(b_start) <= day(a_end))


def trailing_dates(end: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """The same window with Python dates, so a literal filter can prune partitions."""
    return end - dt.timedelta(days=days - 1), end
