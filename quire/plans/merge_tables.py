"""Resolve link titles to page ids, from Parquet tables that dump_tables wrote."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.operators.links import resolve_category_links, resolve_links, resolve_redirects, split_pages
from quire.schemas import CATEGORY_NS
from quire.sinks.tables import write_tsv


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dumpPath", required=True, help="page table")
    p.add_argument("--outputPath", required=True)
    one = p.add_mutually_exclusive_group()
    one.add_argument("--pagelinksPath")
    one.add_argument("--categorylinksPath")
    one.add_argument("--redirectPath")
    a = p.parse_args(args)
    run(session.build("merge-tables"), a.dumpPath, a.outputPath, a.pagelinksPath, a.categorylinksPath, a.redirectPath)


def run(spark: SparkSession, pages_path: str, out: str, pagelinks: str | None = None, categorylinks: str | None = None, redirects: str | None = None) -> None:
    """One of the link tables resolved; without any, the pages split in normal and category pages."""
    pages = spark.read.parquet(pages_path)
    if pagelinks:
        write_tsv(resolve_links(pages, spark.read.parquet(pagelinks)), out)
    elif categorylinks:
        # Category pages here include redirects.
        write_tsv(resolve_category_links(pages, pages.where(F.col("namespace") == CATEGORY_NS), spark.read.parquet(categorylinks)), out)
    elif redirects:
        write_tsv(resolve_redirects(pages, spark.read.parquet(redirects)), out)
    else:
        normal, category = split_pages(pages)
        write_tsv(normal, f"{out}/normal_pages")
        write_tsv(category, f"{out}/category_pages")


if __name__ == "__main__":
    main()
