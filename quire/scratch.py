"""Tables that cut a job's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Without that setting a session of one process (a test) gets a folder of this
    machine; on a cluster that is an error, as executors could not share it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; clean() removes it."""
    return f"{shared_dir(spark)}/quire-{spark.conf.get('spark.app.id', 'session')}"


def written(df: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Write df as Parquet in the scratch folder (or under base) and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks since
    this table. The shuffle files of the write are removed at its end, as nothing
    reads them again.
    """
    spark = df.sparkSession
    path = f"{base or scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove the application's scratch tables. DataFrames that still read them fail from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
