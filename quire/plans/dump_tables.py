"""Table dumps of one kind, in many languages, to Parquet or tab-separated text."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from quire import session
from quire.sinks.tables import write_table
from quire.sources.dumps import TABLES, language_filter, read_dump


def convert(spark: SparkSession, paths: list[str], table: str, languages: list[str] | None = None, strict: bool = False) -> DataFrame:
    chosen = language_filter(languages or []) if table == "langlinks" else None
    return read_dump(spark, paths, table, with_language=True, strict=strict, element_filter=chosen)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dumpFilePaths", nargs="+", required=True)
    p.add_argument("--dumpType", choices=sorted(TABLES), required=True)
    p.add_argument("--outputPath", required=True)
    p.add_argument("--outputFormat", default="csv")
    p.add_argument("--languages", nargs="*", default=[], help="langlinks only: the languages kept")
    p.add_argument("--strict", action="store_true")
    a = p.parse_args(args)
    spark = session.build("dump-tables")
    write_table(convert(spark, a.dumpFilePaths, a.dumpType, a.languages, a.strict), a.outputPath, a.outputFormat)


if __name__ == "__main__":
    main()
