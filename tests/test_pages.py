"""Joins with a page table in buckets of its titles."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import links as L
from quire.operators import views as W
from quire.sinks import pages as P


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, 14 if i % 5 == 0 else 0, f"T{i // 2}", i % 7 == 0, False, ("en", "fr")[i % 2]) for i in range(400)]
    pages = spark.createDataFrame(rows, "id int, namespace int, title string, isRedirect boolean, isNew boolean, languageCode string")
    path = str(tmp_path_factory.mktemp("pages") / "pages")
    return pages, P.write_page_table(pages, path, "bucketed_pages", 6), path


def got(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def named(spark, n, **columns):
    """A third of the rows name one title; some name none that is there, some null."""
    title = F.when(F.col("id") % 3 == 0, "T7").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("T"), F.col("id") % 260))
    rows = spark.range(n).select(F.col("id").cast("int").alias("from"), title.alias("title"), F.when(F.col("id") % 4 == 0, 14).otherwise(0).alias("namespace"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("languageCode"))
    return rows.select("*", *[F.lit(v).alias(k) for k, v in columns.items()])


@pytest.mark.parametrize("most", [1, 3, 256])
def test_equal_rows(spark, tables, most, monkeypatch):
    pages, table, _ = tables
    plain, monkey = P.join_pages, lambda rows, t, keys: plain(rows, t, keys, most)
    monkeypatch.setattr(P, "join_pages", monkey)
    links = named(spark, 2000, fromNamespace=0)
    assert got(P.resolve_links_by_title(table, links)) == got(L.resolve_links(pages, links)) != []
    redirects = named(spark, 900).withColumnRenamed("namespace", "targetNamespace")
    assert got(P.resolve_redirects_by_title(table, redirects)) == got(L.resolve_redirects(pages, redirects)) != []
    cats = named(spark, 900, ctype="page").drop("namespace").withColumnRenamed("title", "to")
    category = pages.where("namespace = 14 AND NOT isRedirect")
    assert got(P.resolve_category_links_by_title(table, cats)) == got(L.resolve_category_links(pages, category, cats)) != []
    visits = named(spark, 900, visits=1).drop("from")
    assert got(P.visits_by_title(table, visits)) == got(W.with_page_ids(pages, visits)) != []
    assert P.resolve_links_by_title(table, links.limit(0)).count() == 0
    # Tables of one language have no such column.
    assert got(P.resolve_links_by_title(table.drop("languageCode"), links.drop("languageCode"))) == got(L.resolve_links(pages.drop("languageCode"), links.drop("languageCode")))


def test_pages_are_not_dealt_again(spark, tables):
    pages, table, _ = tables
    links = named(spark, 2000, fromNamespace=0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        dealt = lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())
        assert len(dealt(L.resolve_links(pages, links))) == 2
        for keys in (["title", "namespace", "languageCode"], ["title", "languageCode"], ["title"]):
            some = links.drop(*{"namespace", "languageCode"} - set(keys))
            usual = some.join(F.broadcast(P.hot_titles(some)), "title", "left_anti").join(table.select("id", *keys).hint("merge"), keys)
            sides = [x for x in dealt(usual) if "title" in x and ", 6" in x]
            assert len(sides) == 1, usual._jdf.queryExecution().executedPlan().toString()
            plan = usual._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and not re.search(r"Exchange[^\n]*\n[^\n]*\n?[^\n]*FileScan[^\n]*bucketed", plan)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_titles_are_few_and_the_hot_ones(spark):
    rows = named(spark, 5000)
    assert P.hot_titles(rows, 1).collect()[0].title == "T7" and P.hot_titles(rows, 20).count() <= 20
    assert P.hot_titles(rows.limit(0)).count() == 0


def test_another_session_opens_the_table(spark, tables):
    pages, table, path = tables
    again = P.open_page_table(spark, path, "pages_again")
    assert got(again) == got(pages) and again.columns == table.columns
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed" in plan
    with pytest.raises(ValueError, match="no page table"):
        P.open_page_table(spark, f"{path}-none", "pages_none")
