"""Edge weights with and without pruning by sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import series as X
from quire.functions import sketch as K
from quire.operators import peaks as P

HOURS = 96


def shapes(spark, rng, n, correlation):
    """Series of a few kinds, smooth and jagged ones, copies, constant ones, one that is null."""
    hours = np.arange(HOURS)
    rows = []
    for i in range(n):
        kind = i % 4
        y = rng.poisson(2, HOURS) * 1.0 if kind == 0 else 5 + 4 * np.sin(hours / (9 + i % 5)) + rng.normal(0, 0.3, HOURS) if kind == 1 else np.where(rng.random(HOURS) < 0.05, rng.integers(1, 50, HOURS), 0) * 1.0 if kind == 2 else np.full(HOURS, float(i % 3))
        rows.append((i, [float(v) for v in np.maximum(y, 0)]))
    rows += [(n, rows[1][1]), (n + 1, rows[2][1]), (n + 2, None)]
    series = spark.createDataFrame(rows, "page_id long, `values` array<double>")
    shape = X.standard(F.col("values")) if correlation else F.col("values")
    return series.select("page_id", shape.alias("shape")), n + 5  # two vertices have no series at all


def all_edges(spark, n):
    ids = spark.range(n)
    return ids.withColumnRenamed("id", "src").join(ids.withColumnRenamed("id", "dst"), F.col("src") <= F.col("dst")).withColumn("weight", F.lit(1.0)), ids


def got(df):
    return {(r.src, r.dst): r.weight for r in df.collect()}


@pytest.mark.parametrize("correlation", [True, False])
@pytest.mark.parametrize("width", [1, 7, 24, 200])
def test_equal_with_and_without_pruning(spark, correlation, width):
    found, n = shapes(spark, np.random.default_rng(2), 40, correlation)
    pairs, vertices = all_edges(spark, n)
    plain = got(P.weighted(vertices, pairs, found, HOURS, correlation))
    sketched = P.with_sketches(found, correlation, width).cache()
    for least in (-1.0, 0.0, 3.0, 30.0, 95.0):
        want = {k: w for k, w in plain.items() if w > least}
        assert got(P.similar_edges(vertices, pairs, sketched, HOURS, least, correlation)) == want
    some = got(P.possible_edges(vertices, pairs, sketched, HOURS, 30.0, correlation).withColumn("weight", F.lit(0)))
    kept = {k for k, w in plain.items() if w > 30.0}
    assert kept <= set(some) and len(kept) > 20 and len(some) < len(plain) * {1: 0.5, 7: 0.5, 24: 0.6, 200: 1}[width]


def test_bounds_hold_at_equality(spark):
    x = np.repeat([3.0, 1.0, 2.0], 4)
    s = X.standard(F.col("a"))
    df = spark.createDataFrame([(x.tolist(),)], "a array<double>")
    bound, weight = df.select(K.dot_bound(K.shape_sketch(s, 4), K.shape_sketch(s, 4)), X.dot(s, s)).first()
    assert weight == pytest.approx(1) and weight <= bound < 1 + 1e-9  # constant on every segment: the sketch is all of it
    values = F.col("a")
    bound, weight = df.select(K.ratio_bound(K.ratio_sketch(values, 4), K.ratio_sketch(values, 4)), X.ratio_similarity(values, values)).first()
    assert weight == 12 and 12 <= bound < 12 + 1e-9


def test_standard_is_the_correlation(spark):
    rng = np.random.default_rng(3)
    a, b = rng.poisson(4, 50) * 1.0, rng.poisson(4, 50) * 1.0
    df = spark.createDataFrame([(a.tolist(), b.tolist(), [7.0] * 50, [])], "a array<double>, b array<double>, c array<double>, d array<double>")
    row = df.select(X.dot(X.standard(F.col("a")), X.standard(F.col("b"))).alias("r"), X.standard(F.col("c")).alias("c"), X.standard(F.col("d")).alias("d"), K.shape_sketch(X.standard(F.col("d"))).alias("k")).first()
    assert row.r == pytest.approx(np.corrcoef(a, b)[0, 1]) and row.c == [0.0] * 50 and row.d == [] and row.k.head == []


def shuffled_bytes(spark, df):
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        stages = store.stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_fewer_bytes_are_shuffled(spark):
    rng = np.random.default_rng(4)
    series = [(i, rng.poisson(3, 720).astype(float).tolist()) for i in range(200)]
    series += [(200 + i, [v + 0.1 for v in series[i][1]]) for i in range(20)]
    found = spark.createDataFrame(series, "page_id long, `values` array<double>").select("page_id", X.standard(F.col("values")).alias("shape"))
    pairs = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in rng.integers(0, 220, (4000, 2))] + [(i, 200 + i, 1.0) for i in range(20)], "src long, dst long, weight double")
    vertices, sketched = spark.range(220), P.with_sketches(found).cache()
    sketched.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = shuffled_bytes(spark, P.weighted(vertices, pairs, sketched.select("page_id", "shape"), 720))
        pruned = shuffled_bytes(spark, P.similar_edges(vertices, pairs, sketched, 720, 714.0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    print(whole, pruned)
    assert pruned < whole / 3
