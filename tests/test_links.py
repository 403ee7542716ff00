import pytest

from quire.operators import links as L

PAGES = [(1, 0, "A", False, False), (2, 0, "B", True, False), (3, 14, "C", False, True), (4, 14, "D", True, False), (5, 0, "C", False, False)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "id int, namespace int, title string, isRedirect boolean, isNew boolean")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_namespaces(pages):
    assert pairs(L.pages_by_namespace(pages, 0), "id") == [(1,), (2,), (5,)]
    assert pairs(L.pages_by_namespace(pages, 14, keep_redirects=False), "id") == [(3,)]
    normal, category = L.split_pages(pages)
    assert normal.count() == 3 and category.count() == 2


def test_links_meet_title_and_namespace(spark, pages):
    links = spark.createDataFrame([(1, 14, "C", 0), (1, 0, "C", 0), (2, 0, "missing", 0)], "`from` int, namespace int, title string, fromNamespace int")
    assert pairs(L.resolve_links(pages, links), "from", "id") == [(1, 3), (1, 5)]


def test_languages_do_not_mix(spark):
    pages = spark.createDataFrame([(1, 0, "A", "en"), (2, 0, "A", "fr")], "id int, namespace int, title string, languageCode string")
    links = spark.createDataFrame([(9, 0, "A", 0, "fr")], "`from` int, namespace int, title string, fromNamespace int, languageCode string")
    assert pairs(L.resolve_links(pages, links), "from", "id") == [(9, 2)]


def test_redirects_need_source_and_target(spark, pages):
    redirects = spark.createDataFrame([(2, 0, "A"), (9, 0, "A"), (4, 0, "missing")], "`from` int, targetNamespace int, title string")
    assert pairs(L.resolve_redirects(pages, redirects), "from", "id") == [(2, 1)]


def test_category_links(spark, pages):
    links = spark.createDataFrame([(1, "C", "page"), (1, "missing", "page"), (9, "C", "page")], "`from` int, `to` string, ctype string")
    found = L.resolve_category_links(pages, L.pages_by_namespace(pages, 14), links)
    assert found.columns == ["from", "title", "id", "ctype"] and pairs(found, "from", "id") == [(1, 3)]


def test_redirect_substitution(spark, pages):
    links = spark.createDataFrame([(1, 2), (1, 1), (1, 5), (1, 5), (2, 5), (5, 2), (77, 5)], "`from` int, id int")
    redirects = spark.createDataFrame([(2, 1)], "`from` int, id int")
    # 1 -> 2 becomes a self link; redirects and unknown pages link to nothing; one of equal links stays.
    assert pairs(L.substitute_redirects(links, redirects, pages), "from", "dest") == [(1, 5), (5, 1)]


def test_redirect_chains(spark, pages):
    links = spark.createDataFrame([(5, 2)], "`from` int, id int")
    chain = spark.createDataFrame([(2, 4), (4, 1)], "`from` int, id int")
    assert pairs(L.substitute_redirects(links, chain, pages), "from", "dest") == [(5, 4)]
    assert pairs(L.substitute_redirects(links, chain, pages, max_hops=2), "from", "dest") == [(5, 1)]
    assert pairs(L.substitute_redirects(links, chain, pages, drop_dangling=True), "from", "dest") == []


def test_ancestry(spark):
    pages = spark.createDataFrame([(1, 14, "Top"), (2, 14, "Sub"), (3, 0, "P"), (4, 0, "Q"), (5, 0, "far")], "id int, namespace int, title string")
    steps = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (5, 3)], "`from` int, id int")
    assert pairs(L.category_ancestry(steps, pages, "Top"), "id") == [(2,), (3,), (4,)]
    assert pairs(L.category_ancestry(steps, pages, "Top", hops=1), "id") == [(2,), (4,)]
