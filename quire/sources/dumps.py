"""Table dumps: INSERT statements of six tables, one statement per text line.

A tuple is a match of its table's pattern; the pattern's groups are the columns.
The default patterns keep the loose reading that existing outputs were made
with: a text group may run across a tuple that does not fit. strict=True reads
quoted strings with their escapes, tuple by tuple, and undoes the escapes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas as S

#: A group separator that text dumps do not hold.
_SEP = "\u0001"
_STRING = r"'((?:[^'\\]|\\.)*+)'"
_ANY = r"((?:'(?:[^'\\]|\\.)*+'|[^,()'])*+)"


@dataclass(frozen=True)
class TableSpec:
    """How the tuples of a table are read. groups: the pattern's groups that are columns, in schema order."""

    name: str
    schema: T.StructType
    pattern: str
    strict: str
    groups: tuple[int, ...]
    keep: Callable[[], Column]


def _in_kept(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isin(*S.KEPT_NAMESPACES)
    return ok


def _strict(*kinds: str) -> str:
    parts = {"i": r"(-?\d+)", "s": _STRING, "b": "([01])", "f": r"([-+\d.eE]+)", "a": _ANY}
    return r"\(" + r",\s*".join(parts[k] for k in kinds) + r"\)"


#: The patterns of the six tables' tuples.
TABLES = {
    t.name: t
    for t in (
        TableSpec("page", S.PAGE, r"\((\d+),(\d+),'(.*?)','(.*?)',([01]),([01]),([\d\.]+?),'(\d{14})',(.*?),(\d+),(\d+),(.*?),(.*?)\)", _strict(*"iissbbfsaiiaa"), tuple(range(1, 13)), lambda: _in_kept("namespace")),
        TableSpec("pagelinks", S.PAGE_LINK, r"\((\d+),(\d+),'(.*?)',(\d+)\)", _strict(*"iisi"), (1, 2, 3, 4), lambda: _in_kept("namespace", "fromNamespace")),
        TableSpec("langlinks", S.LANG_LINK, r"\((\d+),'(.*?)','(.*?)'\)", _strict(*"iss"), (1, 2, 3), lambda: F.col("title") != ""),
        TableSpec("redirect", S.REDIRECT, r"\((\d+),(\d+),'(.*?)',(.*?),(.*?)\)", _strict(*"iisaa"), (1, 2, 3, 4, 5), lambda: _in_kept("targetNamespace")),
        TableSpec("category", S.CATEGORY, r"\((\d+),'(.*?)',(\d+),(\d+),(\d+)\)", _strict(*"isiii"), (1, 2, 3, 4, 5), lambda: F.lit(True)),
        TableSpec("categorylinks", S.CATEGORY_LINK, r"\((\d+),'(.*?)','(.*?)','(.*?)','(.*?)','(.*?)','(.*?)'\)", _strict(*"issssss"), tuple(range(1, 8)), lambda: F.lit(True)),
    )
}
_TIMES = {"touched": "yyyyMMddHHmmss", "timestamp": "yyyy-MM-dd HH:mm:ss"}


def insert_payload(lines: DataFrame, table: str, column: str = "value") -> DataFrame:
    """The tuple text of the table's INSERT lines, as column payload; other columns stay."""
    value = F.col(column)
    rows = lines.where(value.startswith(f"INSERT INTO `{table}` VALUES"))
    return rows.withColumn("payload", F.trim(F.split_part(value, F.lit(" VALUES "), F.lit(2)))).drop(column)


def parse_payload(payloads: DataFrame, table: str, strict: bool = False, element_filter: Callable[[], Column] | None = None, with_rejects: bool = False) -> DataFrame:
    """A row for each tuple in column payload, by the table's schema; other columns follow.

    element_filter gives a further predicate on the parsed columns, next to the
    table's own. Tuples whose whole numbers do not fit are rejected; with_rejects
    returns only those, as text.
    """
    spec = TABLES[table]
    pattern = spec.strict if strict else spec.pattern
    others = [c for c in payloads.columns if c != "payload"]
    tuples = payloads.select(*others, F.explode(F.regexp_extract_all("payload", F.lit(pattern), F.lit(0))).alias("_tuple"))
    joined = F.regexp_replace("_tuple", pattern, _SEP.join(f"${g}" for g in spec.groups))
    cells = tuples.select(*others, "_tuple", F.split(joined, _SEP, -1).alias("_cells"))
    columns, fits = [], F.lit(True)
    for n, field in enumerate(spec.schema):
        cell = F.get("_cells", F.lit(n))
        if isinstance(field.dataType, T.IntegerType):
            fits = fits & cell.try_cast("int").isNotNull()
            cell = cell.try_cast("int")
        elif isinstance(field.dataType, T.DoubleType):
            cell = cell.try_cast("double")
        elif isinstance(field.dataType, T.BooleanType):
            cell = cell == "1"
        elif isinstance(field.dataType, T.TimestampType):
            cell = F.try_to_timestamp(cell, F.lit(_TIMES[field.name]))
        elif strict:
            cell = F.regexp_replace(cell, r"\\(.)", "$1")
        if table == "langlinks" and field.name == "title":
            cell = F.replace(cell, F.lit(" "), F.lit("_"))
        columns.append(cell.alias(field.name))
    if with_rejects:
        return cells.where(~fits).select(*others, F.col("_tuple").alias("tuple"))
    rows = cells.where(fits).select(*columns, *others).where(spec.keep())
    return rows.where(element_filter()) if element_filter else rows


def parse_lines(lines: DataFrame, table: str, **options) -> DataFrame:
    """Rows of a table from text lines (column value)."""
    return parse_payload(insert_payload(lines, table), table, **options)


_FILE = r"^([^-]+?)(?:wiki)?-([^-]+)-([^.\-]+)"


def dump_info(file_name: str) -> tuple[str, str, str]:
    """(language, date, table) of a dump's file name."""
    found = re.match(_FILE, os.path.basename(file_name))
    if not found:
        raise ValueError(f"not a dump's file name: {file_name}")
    return found.group(1), found.group(2), found.group(3)


def dump_info_columns(file_name: Column) -> list[Column]:
    """langCode, dateCode and dumpType of a column of file names."""
    return [F.regexp_extract(file_name, _FILE, n).alias(c) for n, c in enumerate(("langCode", "dateCode", "dumpType"), 1)]


#: Endings of files that have to be unpacked from their start, in one task.
UNSPLITTABLE = (".gz", ".zst", ".lz4", ".snappy", ".deflate")
#: Packed bytes of such a file that one task parses; unpacked they are some five times as many.
DEAL_BYTES = 24 << 20


def read_payloads(spark: SparkSession, paths: str | list[str], table: str, deal_bytes: int = DEAL_BYTES) -> DataFrame:
    """(payload, file_name) of the table's INSERT lines in dump files, plain or compressed.

    A file that cannot be split is unpacked by one task; if it is larger than
    deal_bytes, its lines are then dealt out by a hash of their text, so that
    parsing, the costly part, has a task for each deal_bytes of all such files.
    Other lines stay where they were read. Only names and sizes of files are listed first.
    """
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(paths).select("path", "length").collect()]
    whole = [(p, n) for p, n in files if p.endswith(UNSPLITTABLE)]

    def payloads(some) -> DataFrame:
        lines = spark.read.text(some).select("value", F.col("_metadata.file_name").alias("file_name"))
        return insert_payload(lines, table).select("payload", "file_name")

    if not any(n > deal_bytes for _, n in whole):
        return payloads(paths)
    dealt = payloads([p for p, _ in whole]).repartition(-(-sum(n for _, n in whole) // deal_bytes), F.xxhash64("payload"))
    rest = [p for p, _ in files if not p.endswith(UNSPLITTABLE)]
    return dealt.unionByName(payloads(rest)) if rest else dealt


def read_dump(spark: SparkSession, paths: str | list[str], table: str, with_language: bool = False, deal_bytes: int = DEAL_BYTES, **options) -> DataFrame:
    """Rows of a table from dump files, plain or compressed; languageCode comes from the file name."""
    rows = read_payloads(spark, paths, table, deal_bytes)
    more = [F.regexp_extract("file_name", _FILE, 1).alias("languageCode")] if with_language else []
    return parse_payload(rows.select("payload", *more), table, **options)


def language_filter(languages: list[str]) -> Callable[[], Column] | None:
    """The element filter of langlinks: the languages kept, all if the list is empty."""
    return (lambda: F.col("lang").isin(*languages)) if languages else None


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page table with languageCode, from a dump or from Parquet."""
    if re.search(r"\.sql(\.(bz2|gz))?$", path):
        return read_dump(spark, path, "page", with_language=True)
    return spark.read.schema(S.PAGE_LANG).parquet(path)
