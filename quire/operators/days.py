"""Statistics of a page's days, which add up to those of any period.

A row holds what one day of one page adds to sums, squares, counts and maxima.
Periods are sums over their days, so the history of visits is read once, when its
days are counted, and never again; what needs single visits (bursts) looks only
at days whose largest visit passes the threshold.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates import period_hours
from quire.operators import visits as V

KEY = ("languageCode", "page_id", "day")


def day_stats(visits: DataFrame) -> DataFrame:
    """(languageCode, page_id, day, entries, hours, total, squares, most) of every page-day with visits.

    squares is of the hours' sums; most is the largest single entry.
    """
    hour = F.date_trunc("HOUR", F.col("visit_time")).alias("hour")
    by_hour = visits.groupBy("languageCode", "page_id", hour).agg(F.sum(F.col("count").cast("long")).alias("n"), F.count("*").alias("entries"), F.max("count").alias("most"))
    n = F.col("n").cast("double")
    sums = F.sum("entries").alias("entries"), F.count("*").alias("hours"), F.sum("n").alias("total"), F.sum(n * n).alias("squares"), F.max("most").alias("most")
    return by_hour.groupBy("languageCode", "page_id", F.to_date("hour").alias("day")).agg(*sums)


def in_days(days: DataFrame, start: date, end: date) -> DataFrame:
    """Days from the first to the last; the predicates reach a table partitioned by day."""
    return days.where((F.col("day") >= F.lit(start)) & (F.col("day") <= F.lit(end)))


def stats(days: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, mean, variance) over all hours of the period, as operators.visits.stats has them."""
    n = float(period_hours(start, end))
    sums = in_days(days, start, end).groupBy("page_id").agg(F.sum("total").cast("double").alias("s"), F.sum("squares").alias("q"))
    return sums.select("page_id", (F.col("s") / n).alias("mean"), F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)).alias("variance"))


def daily_maximum(days: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, daily_max): the most visits on one day of the period."""
    per_day = in_days(days, start, end).groupBy("page_id", "day").agg(F.sum("total").alias("n"))
    return per_day.groupBy("page_id").agg(F.max("n").alias("daily_max"))


def _day() -> Column:
    return F.to_date("visit_time")


def burst_days(days: DataFrame, history: date, start: date, end: date, burst_rate: float, burst_count: int) -> DataFrame:
    """(page_id, day, threshold): the days from start on that can hold an entry of a page that may burst.

    A day counts if its largest entry is above the page's threshold, a page if its days that count hold more than burst_count entries.
    """
    limits = V.thresholds(stats(days, history, end), burst_rate)
    high = in_days(days, start, end).join(limits, "page_id").where(F.col("most") > F.col("threshold"))
    per_day = high.groupBy("page_id", "day", "threshold").agg(F.sum("entries").alias("entries"))
    enough = per_day.groupBy("page_id").agg(F.sum("entries").alias("n")).where(F.col("n") > burst_count)
    return per_day.join(enough, "page_id", "left_semi").select("page_id", "day", "threshold")


def burst_pages(visits: DataFrame, days: DataFrame, history: date, start: date, end: date, burst_rate: float, burst_count: int) -> DataFrame:
    """page_id with more than burst_count entries above the threshold, as operators.peaks.burst_pages has them.

    Visits are read for burst_days alone.
    """
    high = burst_days(days, history, start, end, burst_rate, burst_count)
    rows = V.in_period(visits, start, end).withColumn("day", _day()).join(high, ["page_id", "day"]).where(F.col("count") > F.col("threshold"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > burst_count).select("page_id")
