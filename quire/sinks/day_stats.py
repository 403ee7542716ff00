"""The day statistics as a table that grows by the day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.days import day_stats, in_days
from quire.operators.visits import in_period

DAY_STATS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("entries", T.LongType()), T.StructField("hours", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("squares", T.DoubleType()), T.StructField("most", T.IntegerType()), T.StructField("day", T.DateType()), T.StructField("languageCode", T.StringType()),
])


class DayStatsStore:
    """Parquet, a folder for each day and language: a day written again takes the place of itself, others are not touched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, visits: DataFrame, start: date, end: date) -> None:
        """Count the days of a period from visits; of a table of folders by day, only these are read."""
        rows = day_stats(in_period(visits, start, end)).select(DAY_STATS.fieldNames())
        rows.hint("rebalance", "day", "languageCode").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "languageCode").parquet(self.path)

    def read(self, start: date, end: date, language: str | None = None) -> DataFrame:
        rows = in_days(self.spark.read.schema(DAY_STATS).parquet(self.path), start, end)
        return rows if language is None else rows.where(F.col("languageCode") == language)
