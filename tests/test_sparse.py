"""Ratios from the hours of a series that are not 0."""

from quire.functions import series as X


def test_sparse_ratio_equals_the_dense_one(spark):
    rows = [([0.0, 2.0, 0.0, 3.0, 1.0], [1.0, 3.0, 0.0, 0.0, 1.0]), ([0.0] * 5, [1.0] * 5), ([1.5, 1.0, 9.0, 4.0, 5.0], [1.0, 2.0, 9.5, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select(X.ratio_similarity("a", "b"), X.sparse_ratio_similarity(X.sparse("a"), "b"), X.sparse("a").alias("s"))
    got = df.collect()
    assert all(r[0] == r[1] for r in got) and got[0].s.at == [1, 3, 4] and got[1].s["values"] == []
