"""Small files, written and read whole by the driver in any file system Spark knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One file at path with this text and no other; a file that is there is replaced."""
    _, target, fs = _hadoop(spark, path)
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        raise ValueError(f"{path} is a folder")
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """The text of a file, or None if there is none."""
    _, target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text_file(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    """Let a file appear at path with its whole text at once. False if one is there and replace is not set."""
    hadoop, target, fs = _hadoop(spark, path)
    if not replace and fs.exists(target):
        return False
    aside = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    write_text_file(spark, aside, text)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE if replace else getattr(hadoop.Options.Rename, "NONE")
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(aside), target, options)
    except Py4JJavaError as e:
        fs.delete(hadoop.Path(aside), False)
        if not replace and "AlreadyExists" in str(e.java_exception.getClass()):
            return False
        raise
    return True


def delete_folder(spark: SparkSession, path: str) -> None:
    _, target, fs = _hadoop(spark, path)
    fs.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    _, target, fs = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    _, path, fs = _hadoop(spark, source)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")
