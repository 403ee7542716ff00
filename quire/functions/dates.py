"""Dates, periods and the coverage of intervals."""

from __future__ import annotations

import os
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnavailableVisitsError(Exception):
    """The visit table does not cover the period asked for."""


def date_range(start: date, end: date, step_days: int = 1) -> list[date]:
    """All dates from start to end, both included; start after end is an error."""
    if start > end:
        raise ValueError("start date must be before end date")
    return [start + timedelta(days=n) for n in range(0, (end - start).days + 1, step_days)]


def earliest(current: Column, new: Column) -> Column:
    """The earlier of a timestamp and the midnight that begins a date."""
    return F.least(current, F.to_timestamp(new))


def latest(current: Column, new: Column) -> Column:
    """The later of a timestamp and the midnight that ends a date."""
    return F.greatest(current, F.to_timestamp(F.date_add(new, 1)))


def period_hours(start: date, end: date) -> int:
    """Hours from the first to the last day, both whole."""
    return 24 * ((end - start).days + 1)


def elapsed_hours(start: date, time: Column) -> Column:
    """Whole hours since the midnight that begins start."""
    return F.floor((F.unix_micros(time) - F.unix_micros(F.to_timestamp(F.lit(start)))) / F.lit(3_600_000_000)).cast("int")


def history_start(start: date, end: date, whole: bool = False) -> date:
    """Where the history before a period begins.

    It is as many days earlier as the day part of the calendar period from start
    to end has (so 1 August to 1 October gives none); whole takes the period's length.
    """
    if whole:
        return start - ((end - start) + timedelta(days=1))
    if start.day <= end.day:
        return start - timedelta(days=end.day - start.day)
    # Whole months that fit lead to a day in the month before end's.
    year, month = (end.year, end.month - 1) if end.month > 1 else (end.year - 1, 12)
    last = (date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day
    return start - (end - date(year, month, min(start.day, last)))


def covered(meta: DataFrame, start: date, end: date) -> DataFrame:
    """One row: covered, whether the closed date intervals of meta hold every day from start to end."""
    days = meta.select(F.to_date("start_time").alias("s"), F.to_date("end_time").alias("e"))
    days = days.select(F.greatest("s", F.lit(start)).alias("s"), F.least("e", F.lit(end)).alias("e")).where("s <= e")
    days = days.select(F.explode(F.expr("sequence(s, e, interval 1 day)")).alias("day")).distinct()
    return days.agg((F.count("*") == (end - start).days + 1).alias("covered"))


def check_available(meta: DataFrame, start: date, end: date) -> None:
    """Raise unless the period is covered; one row reaches the driver."""
    if not covered(meta, start, end).first()[0]:
        raise UnavailableVisitsError(f"visits from {start} to {end} are not available")


def views_file(base: str, day: date, legacy: bool) -> str:
    """Where the page-view file of a day lies."""
    name = f"pagecounts-{day:%Y-%m-%d}.bz2" if legacy else f"pageviews-{day:%Y%m%d}-user.bz2"
    return os.path.join(base, name)
