"""From page views to visit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.hours import hour_code, hour_visits, visits_of_day

_KEY = ["title", "languageCode", "namespace"]


def merge_views(views: DataFrame, min_daily: int, *more_keys: str) -> DataFrame:
    """One row per page (and day): the access methods' visits added, pages above min_daily kept.

    Hours are added as twenty-four sums, which combine before the shuffle; no
    strings are gathered.
    """
    keys = [*_KEY, *more_keys]
    # The code is read once, into a row for each hour; the day's total goes with the first.
    hours = views.select(*keys, "dailyVisits", F.posexplode_outer(hour_visits(F.col("hourlyVisits"))).alias("at", "entry"))
    daily = F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, F.col("dailyVisits").cast("long")))
    sums = hours.select(*keys, "dailyVisits", "at", "entry.hour", "entry.visits").groupBy(*keys)
    sums = sums.agg(daily.alias("dailyVisits"), *[F.sum(F.when(F.col("hour") == h, F.col("visits"))).cast("long").alias(f"h{h}") for h in range(24)])
    seen = F.filter(F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("visits")) for h in range(24)]), lambda x: x["visits"].isNotNull())
    rows = sums.where(F.col("dailyVisits") > min_daily)
    return rows.select(*keys, F.lit("web").alias("source"), F.col("dailyVisits").try_cast("int").alias("dailyVisits"), hour_code(seen).alias("hourlyVisits"))


def page_visits(views: DataFrame, min_daily: int, hourly_from: int, date: Column, merged: bool = True) -> DataFrame:
    """(languageCode, title, namespace, visits): the visits of each page-day above min_daily.

    merged adds the access methods first, as the current format needs; the legacy
    format has one line per page.
    """
    rows = views.withColumn("_date", date)
    rows = merge_views(rows, min_daily, "_date") if merged else rows.where(F.col("dailyVisits") > min_daily)
    return rows.select("languageCode", "title", "namespace", visits_of_day(F.col("dailyVisits"), F.col("hourlyVisits"), F.col("_date"), hourly_from).alias("visits"))


def with_page_ids(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """Page visits of known pages, with their ids."""
    keys = ["title", "namespace", "languageCode"]
    return visits.join(pages.select("id", *keys), keys).select("title", "namespace", "id", "visits", "languageCode")


def visit_rows(pages: DataFrame, visits: DataFrame, keep_redirects: bool = False) -> DataFrame:
    """The stored form: (languageCode, page_id, visit_time, count), a row for each visit."""
    kept = pages if keep_redirects else pages.where(~F.col("isRedirect"))
    rows = with_page_ids(kept, visits).select("languageCode", F.col("id").cast("long").alias("page_id"), F.explode("visits").alias("v"))
    return rows.select("languageCode", "page_id", F.col("v.time").alias("visit_time"), F.col("v.count").alias("count"))
