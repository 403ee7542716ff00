"""Page-view files as they arrive: the batch parsers over a file stream.

append_visits takes every file for one whole day: page-days are complete within a
file and need no state. append_page_days takes files that hold pieces of days, in
any order and more than once: lines wait in a state until their day closes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.views import page_visits, visit_rows
from quire.sinks.snapshots import SnapshotVisitStore
from quire.sinks.visits import VisitStore
from quire.sources.views import parse_views, view_date


def stream_views(spark: SparkSession, folder: str, legacy: bool = False, **options) -> DataFrame:
    """Page views of all files in a folder, now and later, with the column date."""
    lines = spark.readStream.format("text").load(folder)
    lines = lines.select("value", view_date(F.col("_metadata.file_name")).alias("date"))
    return parse_views(lines, legacy, **options)


def append_visits(views: DataFrame, pages: DataFrame, store: VisitStore, checkpoint: str, min_daily: int = 100, hourly_from: int = 0, legacy: bool = False, once: bool = True) -> StreamingQuery:
    """Append the visit rows of each micro-batch to a store, and the days they cover.

    A micro-batch that runs again after a failure takes the place of what it wrote
    before: writes are named by the checkpoint and the batch.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            visits = page_visits(batch.withColumnRenamed("date", "day"), min_daily, hourly_from, F.col("day"), merged=not legacy)
            days = sorted(r["date"] for r in batch.select("date").distinct().collect())
            if isinstance(store, SnapshotVisitStore):
                store.commit(visit_rows(pages, visits), [(d, d) for d in days], f"{name}-{n}")
                return
            store.append(visit_rows(pages, visits), f"{name}-{n}")
            for day in days:
                store.append_meta(day, day, f"{name}-{n}-{day}")
        finally:
            batch.unpersist()

    start = views.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (start.trigger(availableNow=True) if once else start).start()


#: A state that is kept on disk, so that page-days that wait do not fill the memory.
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_days(lines: DataFrame, lateness_days: int = 2, legacy: bool = False, **options) -> DataFrame:
    """(value, date): the distinct lines of each page-day, once its day is closed. lines: (value, date), a stream.

    A day closes when a line of a day at least lateness_days after it has come,
    one in a comment included, so that a file of one comment ends a feed. Lines of
    a closed day are dropped and counted by the query's progress as late. Lines of
    one day that are equal count once, whatever files they came in: the state of a
    page-day is the set of its lines, of which there are a few, one for each access method.
    """
    timed = lines.select("value", F.to_timestamp("date").alias("time")).withWatermark("time", f"{lateness_days} days")
    # What names the time is not moved ahead of the watermark: comments have to reach it.
    line = F.when(F.col("time").isNotNull(), F.col("value"))
    rows = parse_views(timed.select(line.alias("value"), "time", line.alias("line")), legacy, **options)
    waiting = rows.groupBy("time", "languageCode", "title", "namespace").agg(F.collect_set("line").alias("lines"))
    return waiting.select(F.explode("lines").alias("value"), F.to_date("time").alias("date"))


def append_page_days(
    spark: SparkSession, folder: str, pages: DataFrame, store: SnapshotVisitStore, checkpoint: str, lateness_days: int = 2, min_daily: int = 100, hourly_from: int = 0,
    legacy: bool = False, files_per_batch: int = 1000, once: bool = True, **options,
) -> StreamingQuery:
    """Append the visit rows of page-days to a store when their days close, with the days they cover.

    The result is that of the batch job over all distinct lines, however they are
    split over files. A micro-batch that runs again takes the place of itself.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    lines = lines.select("value", view_date(F.col("_metadata.file_name")).alias("date"))

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            days = sorted(r["date"] for r in batch.select("date").distinct().collect())
            if days:
                views = parse_views(batch, legacy, **options)
                visits = page_visits(views.withColumnRenamed("date", "day"), min_daily, hourly_from, F.col("day"), merged=not legacy)
                store.commit(visit_rows(pages, visits), [(d, d) for d in days], f"{name}-{n}")
        finally:
            batch.unpersist()

    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ON_DISK)
    try:
        start = page_days(lines, lateness_days, legacy, **options).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (start.trigger(availableNow=True) if once else start).start()
    finally:
        spark.conf.set(_STATE_STORE, before)
