from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import series as X
from quire.operators import peaks as P
from quire.operators import visits as V

START, END = date(2020, 1, 1), date(2020, 1, 2)


def visits(spark, *rows):
    return spark.createDataFrame([("en", p, datetime(2020, 1, 1) + timedelta(hours=h), n) for p, h, n in rows], "languageCode string, page_id long, visit_time timestamp, count int")


def of(spark, column, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(column.alias("x")).first()["x"]


def test_period_is_whole_days(spark):
    v = visits(spark, (1, -1, 1), (1, 0, 2), (1, 47, 3), (1, 48, 4))
    assert sorted(r["count"] for r in V.in_period(v, START, END, "en").collect()) == [2, 3]
    assert V.in_period(v, START, END, "fr").count() == 0


def test_series_sorted_and_cut(spark):
    v = visits(spark, (1, 30, 5), (1, 2, 3), (2, 1, 1))
    rows = {r.page_id: r.visits for r in V.series(v).collect()}
    assert [x["count"] for x in rows[1]] == [3, 5]
    cut = {r.page_id: len(r.visits) for r in V.cut_history(V.series(v), date(2020, 1, 2)).collect()}
    assert cut == {1: 1, 2: 0}
    assert V.long_form(V.series(v)).count() == 3


def test_dense_adds_repeated_hours(spark):
    (row,) = V.dense(visits(spark, (1, 3, 5), (1, 3, 2), (1, 99, 7)), START, END).collect()
    assert len(row["values"]) == 48 and row["values"][3] == 7 and sum(row["values"]) == 7


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 47), st.integers(1, 50)), min_size=1, max_size=30))
def test_stats_count_empty_hours(spark, entries):
    grid = np.zeros(48)
    for h, n in entries:
        grid[h] += n
    row = V.stats(visits(spark, *[(1, h, n) for h, n in entries]), START, END).first()
    assert row.mean == pytest.approx(grid.mean()) and row.variance == pytest.approx(grid.var(ddof=1))


def test_bursts_are_strict(spark):
    v = visits(spark, *[(1, h, 1) for h in range(48)], (1, 30, 99), (1, 31, 99), (2, 30, 1))
    assert [r.page_id for r in P.burst_pages(v, START, START, END, 2.0, 1).collect()] == [1]
    assert P.burst_pages(v, START, START, END, 2.0, 2).count() == 0
    # The threshold is of the whole period, the entries of its second day only.
    assert P.burst_pages(v, START, date(2020, 1, 3), END, 2.0, 0).count() == 0


def test_active_series_needs_a_busy_day(spark):
    v = visits(spark, (1, 0, 5), (1, 5, 5), (1, 30, 9), (2, 0, 9), (3, 0, 50))
    active = spark.createDataFrame([(1,), (2,)], "page_id long")
    assert [r.page_id for r in P.active_series(v, active, START, END, 10).collect()] == [1]


def test_top(spark):
    v = visits(spark, (2, 0, 5), (1, 1, 5), (3, 1, 1))
    assert [tuple(r) for r in V.top_pages(v, 2).collect()] == [(1, 5), (2, 5)]


def test_ratio(spark):
    a, b = [0.0, 4.0, 1.0, 2.0], [0.0, 5.0, 2.0, 2.0]
    ask = X.ratio_similarity(F.col("a"), F.col("b"))
    assert of(spark, ask, a, b) == pytest.approx(0.8 + 1.0)  # 0/0 and the ratio of exactly one half count nothing
    assert of(spark, ask, [0.0], [0.0]) == 0


def test_pearson(spark):
    ask = X.pearson(F.col("a"), F.col("b"))
    x, y = [1.0, 2.0, 4.0, 3.0], [2.0, 1.0, 5.0, 5.0]
    assert of(spark, ask, x, y) == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert of(spark, ask, [1.0, 1.0], [1.0, 2.0]) == 0
    with pytest.raises(Exception, match="different lengths"):
        of(spark, ask, [1.0], [1.0, 2.0])


def slow_zscore(y, lag, threshold, influence):
    """The recurrence, step by step."""
    y, f, out = list(y), list(y), [0] * len(y)
    mean, dev = {lag - 1: np.mean(y[:lag])}, {lag - 1: np.std(y[:lag], ddof=1)}
    for i in range(lag, len(y) - 1):
        if abs(y[i] - mean[i - 1]) > threshold * dev[i - 1]:
            out[i] = 1 if y[i] > mean[i - 1] else -1
            f[i] = influence * y[i] + (1 - influence) * f[i - 1]
        mean[i], dev[i] = np.mean(f[i - lag : i]), np.std(f[i - lag : i], ddof=1)
    return out


def test_zscore():
    rng = np.random.default_rng(3)
    y = rng.normal(10, 1, 200)
    y[[60, 150, 199]] += 30
    y[100] -= 30
    found = X.smoothed_zscore(y, 24, 5.0, 0.1)
    assert found[60] == 1 and found[150] == 1 and found[100] == -1 and found[199] == 0  # the last is never tested
    assert found.tolist() == slow_zscore(y, 24, 5.0, 0.1)
    assert X.smoothed_zscore(np.ones(10), 24, 3, 0.1).sum() == 0 and X.smoothed_zscore(np.array([]), 24, 3, 0.1).size == 0


def test_series_go_together_as_alone():
    rng = np.random.default_rng(4)
    for n in (30, 48, 100, 719, 720):
        y = rng.poisson(3, (7, n)).astype(float)
        y[0], y[1], y[2] = 4, 0, np.linspace(0, 9, n)
        y[1, 5] = 50
        trends = X.stl_trend(y)
        assert np.allclose(trends, np.stack([X.stl_trend(v) for v in y]), rtol=0, atol=1e-9)
        marks = X.smoothed_zscore(y, 24, 3.0, 0.1)
        assert marks[3:].tolist() == [slow_zscore(v, 24, 3.0, 0.1) for v in y[3:]] and not marks[0].any()


def slow_loess(y, w, width, degree, at):
    """Local regression at one place, by its normal equations."""
    n = len(y)
    q = min(width, n)
    first = int(np.clip(int(np.round(at)) - (q - 1) // 2, 0, n - q))
    x = np.arange(first, first + q)
    reach = max(np.abs(x - at).max() + max(width - n, 0) // 2, 1.0)
    k = np.clip(1 - (np.abs(x - at) / reach) ** 3, 0, None) ** 3 * w[x]
    a = np.stack([(x - at) ** p for p in range(degree + 1)], 1)
    return np.linalg.lstsq(a * np.sqrt(k)[:, None], y[x] * np.sqrt(k), rcond=None)[0][0]


@pytest.mark.parametrize(("n", "width", "degree"), [(50, 11, 1), (50, 11, 0), (9, 25, 1), (50, 50, 1)])
def test_local_regression(n, width, degree):
    rng = np.random.default_rng(5)
    y, w = rng.normal(size=(3, n)), rng.uniform(0.2, 1, (3, n))
    got = X.Smoother(n, width, degree, 1, 1)(y, w)
    want = [[slow_loess(y[r], w[r], width, degree, at) for at in range(-1, n + 1)] for r in range(3)]
    assert np.allclose(got, want, atol=1e-6)


def slow_stl(y, period, seasonal, inner, outer):
    """The decomposition step by step, every fit by its own normal equations."""
    n = len(y)
    odd = lambda x: int(np.ceil(x)) + 1 - int(np.ceil(x)) % 2
    seasonal = odd(seasonal)
    wide = odd(1.5 * period / (1 - 1.5 / seasonal))
    trend, w = np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for k in range(period):
                own, weight = (y - trend)[k::period], w[k::period]
                cycle[k::period] = [slow_loess(own, weight, seasonal, 1, at) for at in range(-1, len(own) + 1)]
            smooth = cycle
            for window in (period, period, 3):
                smooth = np.convolve(smooth, np.ones(window) / window, "valid")
            season = cycle[period : period + n] - [slow_loess(smooth, np.ones(n), odd(period), 1, at) for at in range(n)]
            trend = np.array([slow_loess(y - season, w, wide, 1, at) for at in range(n)])
        if turn < outer:
            off = np.abs(y - trend - season)
            h = 6 * np.median(off)
            w = np.where(off <= 0.001 * h, 1, np.where(off >= 0.999 * h, 0, (1 - np.minimum(off / h, 1) ** 2) ** 2))
    return trend


@pytest.mark.parametrize(("n", "period", "seasonal"), [(60, 6, 7), (50, 8, 240), (64, 24, 240)])
def test_decomposition(n, period, seasonal):
    rng = np.random.default_rng(6)
    y = 5 + 0.1 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(0, 0.3, n)
    assert np.allclose(X.stl_trend(y, period, seasonal, 2, 0), slow_stl(y, period, seasonal, 2, 0), atol=1e-6)
    assert np.allclose(X.stl_trend(y, period, seasonal, 1, 1), slow_stl(y, period, seasonal, 1, 1), atol=1e-4)


def test_trend():
    hours = np.arange(24 * 20, dtype=float)
    assert np.allclose(X.stl_trend(np.full(480, 7.0)), 7.0)
    assert np.allclose(X.stl_trend(0.3 * hours + 5), 0.3 * hours + 5, atol=1e-6)
    cycle = 10 * np.sin(2 * np.pi * hours / 24)
    assert np.abs(X.stl_trend(cycle)[24:-24]).max() < 0.5
    spike = 5 + 0 * hours + cycle
    spike[200] += 1000
    assert np.abs(X.stl_trend(spike)[100:300] - 5).max() < 5
    assert X.stl_trend(np.array([1.0, 2.0])).tolist() == [1.0, 2.0]  # too short


def test_zscore_pages(spark):
    rng = np.random.default_rng(1)
    rows = [(p, h, int(20 + rng.integers(0, 4))) for p in (1, 2) for h in range(24 * 12)]
    rows += [(1, h, 400) for h in range(24 * 9, 24 * 9 + 30)]
    v = visits(spark, *rows)
    found = P.zscore_pages(v, START, date(2020, 1, 7), date(2020, 1, 12), 72, 4.0, 0.01, 5).collect()
    assert [r.page_id for r in found] == [1] and found[0].active_hours >= 5
