"""The page table in buckets of its titles.

Links, redirects, category links and visits all name pages by title. In a table
bucketed by title the pages of these joins lie where they are needed: only the
other side is dealt, by title. Its hot titles are joined on their own, with the
few pages they name sent to all tasks, as one bucket cannot be split.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sinks.files import read_text_file, write_text_file

#: Titles of the other side that are joined apart, the most frequent ones; so many titles bound the pages that are sent.
HOT_TITLES = 256
#: With it off, a table that lies by title serves joins by title, namespace and language.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_page_table(pages: DataFrame, path: str, name: str, buckets: int = 64) -> DataFrame:
    """Write pages under path in buckets of their titles, and enter them in the session's catalog by name."""
    spark = pages.sparkSession
    # Dealt by title into as many parts as there are buckets: one file each.
    pages.repartition(buckets, "title").write.mode("overwrite").format("parquet").bucketBy(buckets, "title").sortBy("title").option("path", path).saveAsTable(name)
    write_text_file(spark, f"{path}.layout", json.dumps({"schema": pages.schema.jsonValue(), "buckets": buckets}))
    return open_page_table(spark, path, name)


def open_page_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The page table under path, entered in this session's catalog where it is not; joins by title need no more dealing of it."""
    spark.conf.set(_ALL_KEYS, "false")
    if not spark.catalog.tableExists(name):
        layout = json.loads(read_text_file(spark, f"{path}.layout") or "null")
        if layout is None:
            raise ValueError(f"there is no page table at {path}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(layout["schema"]))
        spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (title) SORTED BY (title) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def hot_titles(rows: DataFrame, most: int = HOT_TITLES) -> DataFrame:
    """(title): at most so many, the most frequent ones by a sketch of all rows, which moves no row."""
    top = rows.where("title IS NOT NULL").agg(F.expr(f"approx_top_k(title, {most}, {max(10_000, 4 * most)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select("t.item").toDF("title").distinct()


def join_pages(rows: DataFrame, table: DataFrame, keys: list[str], most: int = HOT_TITLES) -> DataFrame:
    """rows (with title among keys) joined with the columns of a page table, as rows.join(table, keys) has them.

    Which titles count as hot decides only by which of two joins a row goes.
    """
    hot = F.broadcast(hot_titles(rows, most))
    usual = rows.join(hot, "title", "left_anti").join(table.hint("merge"), keys)
    few = F.broadcast(table.join(hot, "title", "left_semi"))
    return usual.unionByName(rows.join(hot, "title", "left_semi").join(few, keys).select(usual.columns))


def resolve_links_by_title(table: DataFrame, links: DataFrame) -> DataFrame:
    """operators.links.resolve_links over a page table."""
    language = ["languageCode"] if {"languageCode"} <= set(table.columns) & set(links.columns) else []
    keys = ["title", "namespace", *language]
    return join_pages(links, table.select("id", *keys), keys).select("from", "id", "title", "fromNamespace", "namespace", *language)


def resolve_redirects_by_title(table: DataFrame, redirects: DataFrame) -> DataFrame:
    """operators.links.resolve_redirects: (from, id, title) of redirects between pages of the table."""
    language = ["languageCode"] if {"languageCode"} <= set(table.columns) & set(redirects.columns) else []
    known = redirects.join(table.select(F.col("id").alias("from"), *language), ["from", *language], "left_semi")
    targets = table.select("id", "title", F.col("namespace").alias("targetNamespace"), *language)
    return join_pages(known, targets, ["title", "targetNamespace", *language]).select("from", "id", "title", *language)


def resolve_category_links_by_title(table: DataFrame, links: DataFrame, namespace: int = 14) -> DataFrame:
    """operators.links.resolve_category_links with the category pages of the table, redirects aside: (from, title, id, ctype)."""
    language = ["languageCode"] if {"languageCode"} <= set(table.columns) & set(links.columns) else []
    known = links.withColumnRenamed("to", "title").join(table.select(F.col("id").alias("from"), *language), ["from", *language], "left_semi")
    targets = table.where((F.col("namespace") == namespace) & ~F.col("isRedirect")).select("id", "title", *language)
    return join_pages(known, targets, ["title", *language]).select("from", "title", "id", "ctype", *language)


def visits_by_title(table: DataFrame, visits: DataFrame) -> DataFrame:
    """operators.views.with_page_ids over a page table: page visits of known pages, with their ids."""
    keys = ["title", "namespace", "languageCode"]
    return join_pages(visits, table.select("id", *keys), keys).select("title", "namespace", "id", "visits", "languageCode")
