"""Components that are kept up to date against a run from nothing."""

import random

import pytest

from quire.operators import growing as N


def table(spark, pairs):
    return spark.createDataFrame(list(pairs), "src int, dst int")


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id int")


def plain(vertices, pairs):
    root = {i: i for i in vertices}
    for a, b in pairs:
        for x in (a, b):
            root.setdefault(x, x)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def check(known, want):
    labels, sizes = known.labels.collect(), known.sizes.collect()
    assert {r.id: r.component for r in labels} == want and len(labels) == len(want)
    count = {c: list(want.values()).count(c) for c in set(want.values())}
    assert {r.component: r["size"] for r in sizes} == count and len(sizes) == len(count)
    best = known.largest().collect()
    assert [(r.component, r["size"]) for r in best] == [min(((c, n) for c, n in count.items()), key=lambda x: (-x[1], x[0]))][: len(want)]


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_a_run_from_nothing(spark, seed):
    rng = random.Random(seed)
    vertices, pairs = range(20, 60, 3), [(rng.randrange(90), rng.randrange(90)) for _ in range(25)]
    known = N.begin(ids(spark, vertices), table(spark, pairs))
    check(known, plain(vertices, pairs))
    for n in (1, 12, 30):
        more = [(rng.randrange(90), rng.randrange(90)) for _ in range(n)]
        pairs += more
        known = N.extend(known, table(spark, [*more, more[0]]))
    check(known, plain(vertices, pairs))


def test_edges_that_change_nothing_and_small_ids(spark):
    known = N.begin(ids(spark, [5]), table(spark, [(7, 8), (8, 9)]))
    check(N.extend(known, table(spark, [(7, 9), (5, 5), (None, 5)])), {5: 5, 7: 7, 8: 7, 9: 7})
    # A new vertex below all others renames what it joins, and two old components become one through new vertices.
    check(N.extend(known, table(spark, [(1, 9), (5, 20), (20, 21), (21, 8)]), ids(spark, [30])), {1: 1, 5: 1, 7: 1, 8: 1, 9: 1, 20: 1, 21: 1, 30: 30})
    empty = N.begin(ids(spark, [1]).limit(0), table(spark, [(1, 2)]).limit(0))
    assert empty.labels.count() == empty.largest().count() == 0
    check(N.extend(empty, table(spark, [(3, 2)])), {2: 2, 3: 2})
