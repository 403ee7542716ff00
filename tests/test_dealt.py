"""Tables that are small as files and large in memory are not sent whole through the driver."""

import pytest
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import growing as N
from quire.operators import links as L
from quire.operators import peaks as P
from quire.scratch import written


def sent_whole(spark, run):
    """The number of broadcasts of the queries that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    first = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    found, every = 0, store.executionsList()
    for k in range(first, every.size()):
        nodes = store.planGraph(every.apply(k).executionId()).allNodes()
        found += sum("BroadcastExchange" in nodes.apply(i).name() for i in range(nodes.size()))
    return found


@pytest.mark.parametrize("correlation", [True, False])
def test_series_are_dealt_out(spark, correlation):
    shapes = spark.range(2000).select(F.col("id").alias("page_id"), F.array_repeat(F.lit(0.5), 720).alias("shape"))
    sketched = written(P.with_sketches(shapes, correlation), "sketched")
    pairs = spark.range(2000).select("id", (F.col("id") * 7 % 2000).alias("dst"), F.lit(1.0).alias("weight")).withColumnRenamed("id", "src")
    vertices = written(spark.range(2000), "nodes")
    edges = P.similar_edges(vertices, pairs, sketched, 720, 1.0, correlation)
    assert sent_whole(spark, lambda: edges.write.format("noop").mode("overwrite").save()) == 0


def test_components_are_dealt_out(spark):
    vertices, tree = spark.range(1, 3000), spark.range(2, 3000).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))

    def run():
        known = N.extend(N.begin(vertices.where("id % 2 = 0"), tree.where("src % 3 = 0")), tree.where("src % 3 > 0"), vertices)
        assert known.largest().collect() == [(1, 2999)]

    assert sent_whole(spark, run) == 0


def test_only_the_largest_component_is_sent(spark):
    vertices = spark.range(1, 3000)
    tree = spark.range(2, 3000).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"), F.lit(1.0).alias("weight"))
    found = {}

    def run():
        nodes, edges = G.largest_component_graph(vertices, tree)
        found["n"] = nodes.join(G.dealt(edges.select("src")), F.col("id") == F.col("src"), "left_semi").count()

    # One row: which component it is. Both tables of the subgraph look it up, edges at both ends.
    assert 1 <= sent_whole(spark, run) <= 3 and found["n"] == 2998


def test_pages_are_dealt_out(spark):
    pages = spark.range(1, 500).select(F.col("id").cast("int").alias("id"), F.lit(0).alias("namespace"), F.concat(F.lit("t"), "id").alias("title"), (F.col("id") % 7 == 0).alias("isRedirect"))
    links = pages.select((F.col("id") - 1).alias("from"), "namespace", "title", F.lit(0).alias("fromNamespace"))
    redirects = pages.where("isRedirect").select(F.col("id").alias("from"), F.lit(0).alias("targetNamespace"), F.concat(F.lit("t"), F.col("id") - 1).alias("title"))

    def run():
        direct = L.substitute_redirects(L.resolve_links(pages, links), L.resolve_redirects(pages, redirects), pages)
        assert direct.count() == 356

    assert sent_whole(spark, run) == 0


def test_query_of_the_grown_graph(spark):
    from quire import queries as Q

    assert sent_whole(spark, lambda: Q.QUERIES["largest_component_grown"](spark, "/root/testdata/sf0.001").collect()) == 0
