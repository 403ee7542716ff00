"""The visit table: periods, series, and sums over an hourly grid that is never built."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates import elapsed_hours, period_hours


def _midnight(day: date) -> Column:
    return F.lit(datetime.combine(day, time()))


def in_period(visits: DataFrame, start: date, end: date, language: str | None = None) -> DataFrame:
    """Rows from the first to the last day, both whole; the predicates reach the Parquet scan."""
    t = F.col("visit_time")
    rows = visits.where((t >= _midnight(start)) & (t < _midnight(end + timedelta(days=1))))
    return rows if language is None else rows.where(F.col("languageCode") == language)


def series(visits: DataFrame) -> DataFrame:
    """(page_id, visits): each page's (visit_time, count) in order of time."""
    rows = visits.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("visit_time", "count"))).alias("visits"))
    return rows.select("page_id", "visits")


def cut_history(grouped: DataFrame, start: date) -> DataFrame:
    """Series without what lies before start."""
    return grouped.withColumn("visits", F.filter("visits", lambda v: v["visit_time"] >= _midnight(start)))


def long_form(grouped: DataFrame) -> DataFrame:
    """(page_id, visit_time, count) of series."""
    return grouped.select("page_id", F.explode("visits").alias("v")).select("page_id", "v.visit_time", "v.count")


def hourly(visits: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, hour, count): visits added by the hour since start; hours outside the period go."""
    rows = visits.select("page_id", elapsed_hours(start, F.col("visit_time")).alias("hour"), "count")
    rows = rows.where(F.col("hour").between(0, period_hours(start, end) - 1))
    return rows.groupBy("page_id", "hour").agg(F.sum(F.col("count").cast("long")).alias("count"))


def dense(visits: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, values): one value for each hour of the period, 0 where there is none."""
    n = period_hours(start, end)
    entries = F.array_sort(F.collect_list(F.struct("hour", F.col("count").cast("double").alias("count"))))
    by_hour = hourly(visits, start, end).groupBy("page_id").agg(entries.alias("e"))
    none = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    # Each hour that has visits is put after the empty ones before it: one pass, whatever the hours.
    before = lambda i: F.coalesce(F.get("e", i - 1)["hour"], F.lit(-1))
    filled = F.transform("e", lambda x, i: F.concat(none(x["hour"] - before(i) - 1), F.array(x["count"])))
    return by_hour.select("page_id", F.flatten(F.concat(filled, F.array(none(F.lit(n - 1) - F.element_at("e", -1)["hour"])))).alias("values"))


def stats(visits: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, mean, variance) over all hours of the period, empty ones included; the variance is the sample's.

    Sums over the hours that have visits are enough: the rest add nothing.
    """
    n = float(period_hours(start, end))
    c = F.col("count").cast("double")
    sums = hourly(visits, start, end).groupBy("page_id").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0))
    return sums.select("page_id", (F.col("s") / n).alias("mean"), variance.alias("variance"))


def thresholds(page_stats: DataFrame, burst_rate: float) -> DataFrame:
    """(page_id, threshold): mean plus burst_rate standard deviations."""
    return page_stats.select("page_id", (F.col("mean") + burst_rate * F.sqrt("variance")).alias("threshold"))


def daily_maximum(visits: DataFrame, start: date, end: date) -> DataFrame:
    """(page_id, daily_max): the most visits on one day of the period."""
    days = hourly(visits, start, end).groupBy("page_id", F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("count").alias("n"))
    return days.groupBy("page_id").agg(F.max("n").alias("daily_max"))


def top_pages(visits: DataFrame, n: int = 1) -> DataFrame:
    """(page_id, total) of the n pages with the most visits; ties go to the lower id."""
    totals = visits.groupBy("page_id").agg(F.sum(F.col("count").cast("long")).alias("total"))
    return totals.orderBy(F.desc("total"), "page_id").limit(n)
