"""Redirects to their end and categories to the top, with cycles."""

import random

import pytest

from quire.operators import closure as C
from quire.operators import links as L
from quire.plans import page_graph


def redirects(spark, pairs, language=None):
    if language:
        return spark.createDataFrame([(a, b, language) for a, b in pairs], "`from` int, id int, languageCode string")
    return spark.createDataFrame(list(pairs), "`from` int, id int")


def walk(pairs):
    """Each page's (id, hops, cycle, in_cycle), one step after the other."""
    to, out = {}, {}
    for a, b in pairs:
        if a is not None and b is not None:
            to[a] = min(to.get(a, b), b)
    for page in to:
        path, at = [page], to[page]
        while at in to and at not in path:
            path.append(at)
            at = to[at]
        out[page] = (at, len(path), None, False) if at not in to else (None, None, min(path[path.index(at) :]), page in path[path.index(at) :])
    return out


def got(df):
    return {r["from"]: (r.id, r.hops, r.cycle, r.in_cycle) for r in df.collect()}


@pytest.mark.parametrize("pairs", [
    [(1, 2), (2, 3)], [(1, 1)], [(1, 2), (2, 1)], [(i, i + 1) for i in range(70)], [(i, (i + 1) % 33) for i in range(33)],
    [(i, i + 1) for i in range(40)] + [(40, 37)], [(5, 6), (6, 7), (7, 5), (1, 5), (2, 1), (9, 8), (8, 20)], [(1, 5), (1, 3), (3, None), (None, 1)],
])
def test_shapes(spark, pairs):
    found = C.redirect_closure(redirects(spark, pairs))
    assert got(found) == walk(pairs) and found.count() == len(walk(pairs))


def test_at_random(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 60
        pairs = [(i, rng.randrange(n + 20 * (seed % 2))) for i in range(n) if rng.random() < 0.9]
        assert got(C.redirect_closure(redirects(spark, pairs))) == walk(pairs)


def test_nothing_and_languages(spark):
    assert C.redirect_closure(redirects(spark, [(1, 2)]).limit(0)).count() == 0
    both = redirects(spark, [(1, 2), (2, 3)], "en").unionByName(redirects(spark, [(2, 1), (1, 2), (3, 4)], "fr"))
    rows = sorted((r.languageCode, r["from"], r.id, r.cycle) for r in C.redirect_closure(both).na.fill(-1, ["id", "cycle"]).collect())
    assert rows == [("en", 1, 3, -1), ("en", 2, 3, -1), ("fr", 1, -1, 1), ("fr", 2, -1, 1), ("fr", 3, 4, -1)]


def test_links_past_chains(spark):
    pages = spark.createDataFrame([(i, i in (2, 3, 4, 7, 8)) for i in range(10)], "id int, isRedirect boolean")
    closure = C.redirect_closure(redirects(spark, [(2, 3), (3, 4), (4, 5), (7, 8), (8, 7)]))
    links = redirects(spark, [(1, 2), (1, 3), (5, 2), (1, 7), (6, 9), (2, 9), (99, 1)])
    pairs = lambda df: sorted((r["from"], r.dest) for r in df.collect())
    assert pairs(L.substitute_closure(links, closure, pages)) == [(1, 5), (1, 7), (6, 9)]
    assert pairs(L.substitute_closure(links, closure, pages, drop_dangling=True)) == [(1, 5), (6, 9)]


def climb(pairs):
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    out = {}
    for a in up:
        near, depth = up[a], 1
        while near:
            for b in near:
                out[a, b] = depth
            near = {c for b in near for c in up.get(b, ())} - {b for x, b in out if x == a}
            depth += 1
    return out


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(30)], [(1, 1), (2, 1)], [(i, (i + 1) % 7) for i in range(7)] + [(9, 0), (9, 3)], "random"])
def test_ancestry(spark, pairs):
    if pairs == "random":
        rng = random.Random(3)
        pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    links, want = redirects(spark, [*pairs, *pairs[:3], (None, 1), (1, None)]), climb(pairs)
    rows = C.ancestry(links).collect()
    assert {(r.id, r.ancestor): r.depth for r in rows} == want and len(rows) == len(want)
    some = spark.createDataFrame([(1,), (3,)], "id int")
    assert {(r.id, r.ancestor): r.depth for r in C.ancestry(links, some).collect()} == {k: d for k, d in want.items() if k[1] in (1, 3)}
    assert {(r.id, r.ancestor): r.depth for r in C.ancestry(links, hops=3).collect()} == {k: d for k, d in want.items() if d <= 3}
    assert C.ancestry(links.limit(0)).count() == 0


def test_category_of_any_depth(spark):
    pages = spark.createDataFrame([(i, 14 if i < 20 else 0, f"C{i}") for i in range(40)], "id int, namespace int, title string")
    steps = redirects(spark, [(i + 1, i) for i in range(25)] + [(5, 19), (3, 8)])
    ids = lambda hops: sorted(r.id for r in L.category_ancestry(steps, pages, "C10", hops).collect())
    up = climb([(r["from"], r.id) for r in steps.collect()])
    for hops in (1, 2, 3, 5, None):
        assert ids(hops) == sorted({a for (a, b), d in up.items() if b == 10 and (hops is None or d <= hops)})


def test_page_graph_to_the_end(spark):
    pages = spark.createDataFrame([(1, 0, "A", False, False), (2, 0, "B", True, False), (3, 0, "C", True, False), (4, 0, "D", False, False), (5, 0, "X", True, False), (6, 0, "Y", True, False)], "id int, namespace int, title string, isRedirect boolean, isNew boolean")
    links = spark.createDataFrame([(1, 0, "B", 0), (1, 0, "X", 0)], "`from` int, namespace int, title string, fromNamespace int")
    hops = spark.createDataFrame([(2, 0, "C"), (3, 0, "D"), (5, 0, "Y"), (6, 0, "X")], "`from` int, targetNamespace int, title string")
    none = spark.createDataFrame([], "`from` int, `to` string, ctype string")
    graph = page_graph.build(pages, links, hops, none, to_the_end=True)
    assert [tuple(r) for r in graph["pagelinks"].collect()] == [(1, 4)]
    assert sorted(tuple(r) for r in graph["redirect_cycles"].collect()) == [(5, 5, True), (6, 5, True)]
    assert "redirect_cycles" not in page_graph.build(pages, links, hops, none)
