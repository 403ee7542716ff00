"""Z-scores that go on: a state for each page, and the marked hours, by the period that was added."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.dates import period_hours
from quire.functions.zscore import ZScores, tail_size
from quire.operators.visits import dense, in_period

_STATE = "page_id bigint, tail array<double>, mean double, square double, largest double, last double"
#: Series whose hours are gone through together.
STACK = 2048


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows; a null list is a row of zeros."""
    flat = column.fill_null([0.0] * width).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def extend_states(states: DataFrame, series: DataFrame, seen: int, hours: int, lag: int, threshold: float, influence: float) -> DataFrame:
    """(page_id, tail, mean, square, largest, last, marks): every page's state after so many further hours.

    states are those after seen hours, series (page_id, values) the new hours. A
    page with no series has no visits in them; one with no state had none before.
    marks are of the hours from number seen - 1 on, which was pending till now.
    """
    held = tail_size(lag, seen)
    rows = states.join(series.select("page_id", "values"), "page_id", "full_outer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STACK):
                batch = whole.slice(at, STACK)
                page, tail, *numbers, values = batch.columns
                state = ZScores(lag, seen, _matrix(tail, held), *(x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in numbers))
                marks = state.extend(_matrix(values, hours), threshold, influence)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([page, lists(state.tail), *map(pa.array, (state.mean, state.square, state.largest, state.last)), lists(marks)], ["page_id", "tail", "mean", "square", "largest", "last", "marks"])

    return rows.select("page_id", "tail", "mean", "square", "largest", "last", "values").mapInArrow(run, f"{_STATE}, marks array<int>")


class ZScoreStore:
    """Parquet, a folder for each period that was added, named by its first and last day.

    A folder holds every page's state at its end and the hours it marked, and is
    written whole or not at all; a period that is added again takes the place of itself.
    """

    def __init__(self, spark: SparkSession, path: str, first: date, lag: int = 72, threshold: float = 3.0, influence: float = 0.01):
        self.spark, self.path, self.first = spark, path.rstrip("/"), first
        self.lag, self.threshold, self.influence = lag, threshold, influence

    def _folder(self, end: date) -> str:
        return f"{self.path}/upto={end}"

    def _state(self, end: date) -> DataFrame:
        if end < self.first:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(f"{_STATE}, marks array<int>").parquet(self._folder(end)).drop("marks")

    def extend(self, visits: DataFrame, start: date, end: date) -> None:
        """Add the days from start to end; those before start are not read, only the state at their end."""
        if start > end or start < self.first:
            raise ValueError(f"cannot add {start} to {end} to z-scores that begin on {self.first}")
        before = start - timedelta(days=1)
        seen = period_hours(self.first, before) if start > self.first else 0
        hours = period_hours(start, end)
        series = dense(in_period(visits, start, end), start, end)
        found = extend_states(self._state(before), series, seen, hours, self.lag, self.threshold, self.influence)
        found.write.mode("overwrite").parquet(self._folder(end))

    def marks(self, *ends: date) -> DataFrame:
        """(page_id, hour, mark) of the marked hours in the periods that end on these days; hour counts from the first day's midnight."""
        parts = None
        begin = self.first
        for end in sorted(ends):
            first = max(period_hours(self.first, begin - timedelta(days=1)) - 1, 0) if begin > self.first else 0
            rows = self.spark.read.schema(f"{_STATE}, marks array<int>").parquet(self._folder(end)).select("page_id", F.posexplode("marks").alias("k", "mark")).where(F.col("mark") != 0)
            rows = rows.select("page_id", (F.col("k") + first).alias("hour"), "mark")
            parts, begin = rows if parts is None else parts.unionByName(rows), end + timedelta(days=1)
        if parts is None:
            return self.spark.createDataFrame([], "page_id bigint, hour int, mark int")
        return parts

    def active_hours(self, skip: int, *ends: date) -> DataFrame:
        """(page_id, active_hours): how many hours are marked +1, after the first skip hours."""
        return self.marks(*ends).where((F.col("mark") > 0) & (F.col("hour") >= skip)).groupBy("page_id").agg(F.count("*").cast("int").alias("active_hours"))
