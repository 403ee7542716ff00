"""Series packed to the hours that differ from their least value."""

import numpy as np
from pyspark.sql import functions as F
from test_similar import shuffled_bytes

from quire.functions import series as X
from quire.operators import peaks as P


def test_packed_dot(spark):
    rng = np.random.default_rng(5)
    few = np.where(rng.random(50) < 0.1, rng.random(50), -0.25).tolist()
    kinds = [few, rng.normal(size=50).tolist(), [0.0] * 50, [2.5] * 50, [None, *few[1:]], [float("nan"), *few[1:]], few[:49], [], None]
    rows = [(i, j, a, b) for i, a in enumerate(kinds) for j, b in enumerate(kinds)]
    df = spark.createDataFrame(rows, "i int, j int, a array<double>, b array<double>").select("i", "j", X.packed(F.col("a")).alias("p"), X.dot(F.col("a"), F.col("b")).alias("want"), "b")
    found = df.select("i", "j", "p", "want", X.packed_dot(F.col("p"), F.col("b"), X.total(F.col("b"))).alias("got")).collect()
    assert len(found) == 81
    for r in found:
        if r.want is None or np.isnan(r.want):
            assert r.got is None or np.isnan(r.got), (r.i, r.j)
        else:
            assert abs(r.got - r.want) < 1e-12, (r.i, r.j)
    packed = {r.i: r.p for r in found}
    assert len(packed[0].at) < 12 and packed[1].at is None and packed[3].at == [] and packed[8] is None


def test_edges_to_pages_without_series_carry_nothing(spark):
    """Each of 20,000 edges carried a sketch of 240 bytes before it turned out that the page at its other end has none."""
    rng = np.random.default_rng(6)
    series = [(i, rng.normal(size=720).tolist()) for i in range(50)]
    sketched = P.with_sketches(spark.createDataFrame(series, "page_id long, `values` array<double>").select("page_id", X.standard(F.col("values")).alias("shape"))).cache()
    vertices = sketched.select(F.col("page_id").alias("id"))
    edges = spark.range(20_000).select((F.col("id") % 50).alias("src"), (F.col("id") + 1_000).alias("dst"), F.lit(1.0).alias("weight"))
    assert shuffled_bytes(spark, P.similar_edges(vertices, edges, sketched, 720, 36.0)) < 1_500_000
