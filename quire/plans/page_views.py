"""Daily page-view files to visit rows."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.functions.dates import date_range
from quire.operators.views import page_visits, visit_rows
from quire.plans import config
from quire.sinks.day_stats import DayStatsStore
from quire.sinks.visits import VisitStore, open_store, save
from quire.sources.dumps import read_pages
from quire.sources.views import read_views


def rows_of(spark: SparkSession, base: str, start: date, end: date, pages: DataFrame, languages: list[str], legacy: bool = False, min_daily: int = 100, hourly_from: int = 0, keep_redirects: bool = False) -> DataFrame:
    """Visit rows of all days of a period, in one scan of their files."""
    views = read_views(spark, base, date_range(start, end), legacy, languages=languages)
    visits = page_visits(views.withColumnRenamed("date", "day"), min_daily, hourly_from, F.col("day"), merged=not legacy)
    return visit_rows(pages, visits, keep_redirects)


def run(spark: SparkSession, store: VisitStore, base: str, pages_path: str, start: date, end: date, languages: list[str], legacy: bool, cfg: dict, days: DayStatsStore | None = None) -> None:
    rows = rows_of(
        spark, base, start, end, read_pages(spark, pages_path), languages, legacy,
        cfg["views.minDailyVisits"], cfg["views.minDailyVisitsHourlySplit"], cfg["views.keepRedirects"],
    )
    save(store, rows, start, end)
    if days:
        days.append(store.visits(start, end), start, end)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config")
    p.add_argument("--basePath", required=True)
    p.add_argument("--startDate", type=date.fromisoformat, required=True)
    p.add_argument("--endDate", type=date.fromisoformat, required=True)
    p.add_argument("--pageDump", required=True)
    p.add_argument("--languages", nargs="+", required=True)
    p.add_argument("--legacy", action="store_true")
    p.add_argument("--outputPath", help="Parquet store; without it rows go to Cassandra")
    p.add_argument("--dayStats", help="folder of day statistics, which the days are added to")
    a = p.parse_args(args)
    cfg = config.load(a.config)
    spark = session.build("page-views", **config.connection(cfg))
    store = open_store(spark, a.outputPath, cfg["store.keyspace"], cfg["store.tableVisits"], cfg["store.tableMeta"])
    run(spark, store, a.basePath, a.pageDump, a.startDate, a.endDate, a.languages, a.legacy, cfg, DayStatsStore(spark, a.dayStats) if a.dayStats else None)


if __name__ == "__main__":
    main()
