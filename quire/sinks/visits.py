"""The stored visits: a table of rows and a table of the periods that it covers."""

from __future__ import annotations

import uuid
from datetime import date, datetime, time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas as S
from quire.functions.dates import check_available
from quire.operators.visits import in_period, series
from quire.sinks.files import list_names
from quire.sinks.snapshots import SnapshotVisitStore

#: Folders under the store's base.
VISITS, META = "pg_count", "visits_meta"
_CASSANDRA = "org.apache.spark.sql.cassandra"


class VisitStore(Protocol):
    """batch names a write: a second one of the same name takes the place of the first."""

    def visits(self, start: date | None = None, end: date | None = None) -> DataFrame: ...

    def meta(self) -> DataFrame: ...

    def append(self, rows: DataFrame, batch: str | None = None) -> None: ...

    def append_meta(self, start: date, end: date, batch: str | None = None) -> None: ...


class ParquetVisitStore:
    """Folders for each write, day and language: a period reads the folders of its days alone."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def visits(self, start: date | None = None, end: date | None = None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*S.VISIT_ROW.fields, T.StructField("batch", T.StringType()), T.StructField("visit_date", T.DateType())])).parquet(f"{self.base}/{VISITS}")
        if start:
            rows = rows.where(F.col("visit_date") >= F.lit(start))
        if end:
            rows = rows.where(F.col("visit_date") <= F.lit(end))
        return rows.select(S.VISIT_ROW.fieldNames())

    def meta(self) -> DataFrame:
        return self.spark.read.schema(S.VISIT_META).parquet(f"{self.base}/{META}")

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        rows = rows.select(*S.VISIT_ROW.fieldNames(), F.to_date("visit_time").alias("visit_date"))
        # Rows of a folder meet in few tasks; adaptive execution splits large folders.
        rows.hint("rebalance", "visit_date", "languageCode").write.mode("overwrite").partitionBy("visit_date", "languageCode").parquet(f"{self.base}/{VISITS}/batch={batch or uuid.uuid4().hex}")

    def append_meta(self, start: date, end: date, batch: str | None = None) -> None:
        _meta_row(self.spark, start, end).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/{META}/batch={batch or uuid.uuid4().hex}")


class CassandraVisitStore:
    """The same over a Cassandra keyspace; needs the connector's jar. Rows have keys there: a second write of one changes nothing."""

    def __init__(self, spark: SparkSession, keyspace: str, visits: str, meta: str):
        self.spark, self.keyspace, self.names = spark, keyspace, (visits, meta)

    def _options(self, n: int) -> dict[str, str]:
        return {"keyspace": self.keyspace, "table": self.names[n]}

    def _read(self, n: int) -> DataFrame:
        try:
            return self.spark.read.format(_CASSANDRA).options(**self._options(n)).load()
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" in str(e):
                raise RuntimeError("the Cassandra connector is not on the class path; add its package to the session") from e
            raise

    def visits(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self._read(0)

    def meta(self) -> DataFrame:
        return self._read(1)

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        rows.write.format(_CASSANDRA).options(**self._options(0)).mode("append").save()

    def append_meta(self, start: date, end: date, batch: str | None = None) -> None:
        _meta_row(self.spark, start, end).write.format(_CASSANDRA).options(**self._options(1)).mode("append").save()


def _meta_row(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.createDataFrame([(datetime.combine(start, time()), datetime.combine(end, time()))], S.VISIT_META)


def open_store(spark: SparkSession, base: str | None, keyspace: str = "pages", visits: str = "page_visits", meta: str = "pagecount_metadata") -> VisitStore:
    """Snapshots in Parquet if there is a base path (the older layout where a base has it), else Cassandra."""
    if not base:
        return CassandraVisitStore(spark, keyspace, visits, meta)
    return ParquetVisitStore(spark, base) if VISITS in list_names(spark, base) else SnapshotVisitStore(spark, base)


def save(store: VisitStore, rows: DataFrame, start: date, end: date) -> None:
    """Rows and the claim to cover the period at once, where the store can; else rows first, so that a write that fails leaves no claim."""
    if isinstance(store, SnapshotVisitStore):
        store.commit(rows, [(start, end)])
        return
    store.append(rows)
    store.append_meta(start, end)


def load_period(store: VisitStore, start: date, end: date, language: str | None = None) -> DataFrame:
    """Visits of a period that the store covers; an error if it does not."""
    check_available(store.meta(), start, end)
    return in_period(store.visits(start, end), start, end, language)


def load_series(store: VisitStore, start: date, end: date, language: str) -> DataFrame:
    return series(load_period(store, start, end, language))


__all__ = ["CassandraVisitStore", "ParquetVisitStore", "SnapshotVisitStore", "load_period", "load_series", "open_store", "save"]
