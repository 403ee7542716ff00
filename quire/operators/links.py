"""Pages, and the links, redirects and categories between them, resolved to page ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schemas as S
from quire.operators.closure import ancestry
from quire.operators.graph import dealt


def pages_by_namespace(pages: DataFrame, namespace: int, keep_redirects: bool = True) -> DataFrame:
    """id, title, isRedirect, isNew (and languageCode, if there) of a namespace's pages."""
    rows = pages.where(F.col("namespace") == namespace)
    rows = rows if keep_redirects else rows.where(~F.col("isRedirect"))
    return rows.select("id", "title", "isRedirect", "isNew", *_language(pages))


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normal pages and category pages, redirects included."""
    return pages_by_namespace(pages, S.PAGE_NS), pages_by_namespace(pages, S.CATEGORY_NS)


def drop_redirect_pages(pages: DataFrame, keep_redirects: bool = False) -> DataFrame:
    return pages if keep_redirects else pages.where(~F.col("isRedirect"))


def _language(*tables: DataFrame) -> list[str]:
    """The language column, if all tables have it: then rows of two languages never meet."""
    return ["languageCode"] if all("languageCode" in t.columns for t in tables) else []


def resolve_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Page links with the id of the page they name; links to missing pages go."""
    keys = ["title", "namespace", *_language(pages, links)]
    return links.join(dealt(pages.select("id", *keys)), keys).select("from", "id", "title", "fromNamespace", "namespace", *_language(pages, links))


def resolve_redirects(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(from, id, title): redirects whose source page exists, with the id of their target, one hop."""
    language = _language(pages, redirects)
    sources = pages.select(F.col("id").alias("from"), *language)
    targets = pages.select("id", "title", F.col("namespace").alias("targetNamespace"), *language)
    rows = redirects.join(dealt(sources), ["from", *language], "left_semi").join(dealt(targets), ["title", "targetNamespace", *language])
    return rows.select("from", "id", "title", *language)


def resolve_category_links(pages: DataFrame, category_pages: DataFrame, links: DataFrame) -> DataFrame:
    """(from, id, title, ctype): category links whose source page exists, with the id of the category's page."""
    language = _language(pages, category_pages, links)
    sources = pages.select(F.col("id").alias("from"), *language)
    targets = category_pages.select("id", "title", *language)
    rows = links.withColumnRenamed("to", "title").join(dealt(sources), ["from", *language], "left_semi").join(dealt(targets), ["title", *language])
    return rows.select("from", "title", "id", "ctype", *language)


def substitute_redirects(links: DataFrame, redirects: DataFrame, pages: DataFrame, max_hops: int = 1, drop_dangling: bool = False) -> DataFrame:
    """(from, dest): distinct links between pages, a redirect as target replaced by where it leads.

    links and redirects are resolved ones. Self links go, and links from redirects
    or unknown pages. By default a redirect is followed for one hop and dest is not
    checked; max_hops follows chains, drop_dangling drops links to redirects.
    """
    language = _language(links, redirects, pages)
    hops = redirects.select(F.col("from").alias("id"), F.col("id").alias("to_r"), *language)
    rows = links.select("from", "id", *language)
    for _ in range(max_hops):
        rows = rows.join(dealt(hops), ["id", *language], "left").select("from", F.coalesce("to_r", "id").alias("id"), *language)
    return _between_pages(rows, pages, language, drop_dangling)


def substitute_closure(links: DataFrame, closure: DataFrame, pages: DataFrame, drop_dangling: bool = False) -> DataFrame:
    """The same with redirects followed to their end, by redirect_closure; a redirect that runs into a cycle stays the target."""
    language = _language(links, closure, pages)
    ends = closure.select(F.col("from").alias("id"), F.col("id").alias("end"), *language)
    rows = links.select("from", "id", *language).join(dealt(ends), ["id", *language], "left").select("from", F.coalesce("end", "id").alias("id"), *language)
    return _between_pages(rows, pages, language, drop_dangling)


def _between_pages(rows: DataFrame, pages: DataFrame, language: list[str], drop_dangling: bool) -> DataFrame:
    """Distinct (from, dest) without self links, from pages that are there and no redirects."""
    rows = rows.where(F.col("from") != F.col("id")).distinct()
    direct = pages.where(~F.col("isRedirect"))
    rows = rows.join(dealt(direct.select(F.col("id").alias("from"), *language)), ["from", *language], "left_semi")
    if drop_dangling:
        rows = rows.join(dealt(direct.select("id", *language)), ["id", *language], "left_semi")
    return rows.select("from", F.col("id").alias("dest"), *language)


def category_ancestry(links: DataFrame, pages: DataFrame, title: str | Column, hops: int | None = 2) -> DataFrame:
    """Distinct (id, title) of the pages that belong to a category within so many hops; None: within any number."""
    wanted = pages.where((F.col("namespace") == S.CATEGORY_NS) & (F.col("title") == title))
    if hops is None or hops > 2:
        found = ancestry(links.select("from", "id"), wanted.select("id"), hops).select(F.col("id").alias("from")).distinct()
        return pages.select("id", "title").join(found, F.col("id") == F.col("from"), "left_semi").distinct()
    step, wanted = links.select("from", F.col("id").alias("to")), wanted.select(F.col("id").alias("to"))
    near = step.join(wanted, "to", "left_semi").select("from")
    found = near
    for _ in range(hops - 1):
        near = step.join(near.select(F.col("from").alias("to")), "to", "left_semi").select("from")
        found = found.union(near)
    return pages.select("id", "title").join(found.distinct(), F.col("id") == F.col("from"), "left_semi").distinct()
