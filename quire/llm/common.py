"""Helpers shared by the corpus operators: scratch tables, word rule, input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch

#: A word, as every operator here counts it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


#: Rows that Python gets at once; with whole texts, Spark's default is too much for an executor's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after seeing to it that the session hands out at most BATCH_ROWS rows of text at once.

    The setting counts when a query runs, and the caller runs it, so it stays.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a scratch table in the shared folder, and read back: this cuts its lineage."""
    return scratch.written(small_batches(df), label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct, out of the way of any other name."""
    return F.struct(*[own_column(df, c).alias(c) for c in df.columns])


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
