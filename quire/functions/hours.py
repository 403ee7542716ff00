"""Hourly codes: "A9B13" is 9 visits in hour 0 and 13 in hour 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entries(code: Column, letters: str) -> Column:
    return F.regexp_extract_all(code, F.lit(f"[{letters}][0-9]+"), F.lit(0))


def hour_visits(code: Column) -> Column:
    """array<struct<hour int, visits int>> of a code, in its order. Hours past 23 (Y, Z) are dropped."""
    return F.transform(_entries(code, "A-X"), lambda x: F.struct((F.ascii(x) - 65).alias("hour"), F.substring(x, 2, 12).try_cast("int").alias("visits")))


def hour_code(hours: Column) -> Column:
    """The code of an array of (hour, visits), by hour."""
    return F.array_join(F.transform(F.array_sort(hours), lambda x: F.concat(F.char(x["hour"] + 65), x["visits"].cast("string"))), "")


def visits_of_day(daily: Column, code: Column, date: Column, hourly_from: int) -> Column:
    """Visits of a page-day: by the hour from hourly_from daily visits on, else one for the day."""
    midnight = F.to_timestamp(date)
    hours = F.transform(hour_visits(code), lambda x: F.struct((midnight + F.make_dt_interval(F.lit(0), x["hour"])).alias("time"), x["visits"].alias("count"), F.lit("Hour").alias("timeResolution")))
    day = F.array(F.struct(midnight.alias("time"), daily.cast("int").alias("count"), F.lit("Day").alias("timeResolution")))
    return F.when(daily >= hourly_from, hours).otherwise(day)
