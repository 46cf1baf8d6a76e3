"""Weeks, month grids and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(x: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", x))


def week_days(x: Column) -> Column:
    return F.sequence(week_start(x), F.date_add(week_start(x), 6))


def month_grid(x: Column) -> Column:
    """42 days from the Monday on or before the first of the month."""
    start = week_start(F.trunc(x, "month"))
    return F.sequence(start, F.date_add(start, 41))


def iso_timestamp(x: Column, now: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x), now)


def epoch(x: Column) -> Column:
    return F.timestamp_seconds(x.try_cast("double"))


def next_days(x: Column, count: int = 7) -> Column:
    """Keys (yyyy-MM-dd) of a day and those after it."""
    return F.transform(F.sequence(F.to_date(x), F.date_add(F.to_date(x), count - 1)), lambda d: F.date_format(d, "yyyy-MM-dd"))
