"""Z-scores that are cut anywhere and gone on with."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_series import slow_zscore

from quire.functions import series as X
from quire.functions.zscore import ZScores, smoothed_zscore
from quire.operators import visits as V
from quire.sinks.zscores import ZScoreStore

FIRST = date(2020, 1, 1)


def day(n):
    return FIRST + timedelta(days=n)


def series(rng, rows, n):
    y = rng.poisson(rng.choice([0.1, 1, 20]), (rows, n)).astype(float)
    y[rng.random(y.shape) < 0.03] += 10.0 ** rng.integers(1, 7)
    return y


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 30), st.integers(1, 250), st.sampled_from([1.5, 3.0, 5.0]), st.sampled_from([0.0, 0.01, 0.5, 1.0]))
def test_cut_at_any_hour(seed, lag, n, threshold, influence):
    rng = np.random.default_rng(seed)
    y = series(rng, 5, n)
    whole = ZScores.of_zeros(lag, 0, 5)
    want = whole.extend(y, threshold, influence)
    state, parts, at = ZScores.of_zeros(lag, 0, 5), [], 0
    while at < n:
        k = int(rng.integers(0, 60))
        parts.append(state.extend(y[:, at : at + k], threshold, influence))
        at += k
    assert np.array_equal(np.concatenate(parts, 1), want) and want.shape == (5, n - 1)
    for field in ("tail", "mean", "square", "largest", "last"):
        assert np.array_equal(getattr(state, field), getattr(whole, field))  # the very numbers


def test_the_state_of_zeros_is_what_zeros_lead_to():
    for seen in (0, 1, 2, 5, 6, 7, 8, 9, 40):
        state, plain = ZScores.of_zeros(6, seen, 2), ZScores.of_zeros(6, 0, 2)
        assert not plain.extend(np.zeros((2, seen)), 3, 0.1).any()
        assert plain.tail.shape == state.tail.shape
        rest = series(np.random.default_rng(seen), 2, 50)
        assert np.array_equal(state.extend(rest, 3, 0.1), plain.extend(rest, 3, 0.1))
    with pytest.raises(ValueError):
        ZScores.of_zeros(1, 0, 1)


def test_running_sums_are_the_windows_own():
    rng = np.random.default_rng(8)
    for _ in range(40):
        y = rng.normal(10, 3, 200) * 10.0 ** rng.integers(-3, 6)
        y[rng.random(200) < 0.05] *= 1e4  # values whose leaving would leave rounding behind
        assert smoothed_zscore(y, 24, 3.0, 0.1).tolist() == slow_zscore(y, 24, 3.0, 0.1)
    flat = np.full(300, 5.0)
    flat[[40, 41, 200]] = [1e6, 7, 6]
    found = smoothed_zscore(flat, 20, 3.0, 0.0)
    assert np.flatnonzero(found).tolist() == [40, 41, 200]  # a flat window has no band, whatever has left it


def test_store_goes_on_by_days(spark, tmp_path):
    rng = np.random.default_rng(9)
    grid = rng.poisson(1.0, (12, 24 * 8))
    grid[rng.random(grid.shape) < 0.03] += 30
    grid[3, : 24 * 5] = 0  # pages that come late
    grid[4, 24 * 2 :] = 0  # and that stay away
    rows = [("en", int(p), datetime(2020, 1, 1) + timedelta(hours=int(h)), int(grid[p, h])) for p, h in np.argwhere(grid)]
    visits = spark.createDataFrame(rows, "languageCode string, page_id long, visit_time timestamp, count int").cache()
    want = {(p, int(h)): int(m) for p, marks in enumerate(smoothed_zscore(grid, 24, 3.0, 0.1)) for h, m in enumerate(marks) if m}
    store = ZScoreStore(spark, str(tmp_path / "z"), FIRST, 24, 3.0, 0.1)
    ends = []
    for a, b in ((0, 2), (3, 3), (4, 4), (5, 7)):
        store.extend(visits, day(a), day(b))
        ends.append(day(b))
    store.extend(visits, day(4), day(4))  # again
    got = {(r.page_id, r.hour): r.mark for r in store.marks(*ends).collect()}
    assert got == want and len(want) > 40
    one = ZScoreStore(spark, str(tmp_path / "one"), FIRST, 24, 3.0, 0.1)
    one.extend(visits, FIRST, day(7))
    assert {(r.page_id, r.hour): r.mark for r in one.marks(day(7)).collect()} == want
    skip = 24 * 3
    active = {p: sum(m > 0 for (q, h), m in want.items() if q == p and h >= skip) for p, _ in want}
    assert {r.page_id: r.active_hours for r in store.active_hours(skip, *ends).collect()} == {p: n for p, n in active.items() if n}
    assert store.marks().count() == 0
    for a, b in ((-1, 2), (3, 2)):
        with pytest.raises(ValueError):
            store.extend(visits, day(a), day(b))


def test_a_new_day_reads_a_day_and_the_state(spark, tmp_path):
    v = spark.createDataFrame([("en", 1, datetime(2020, 1, 1) + timedelta(hours=h), 3 + h % 2) for h in range(72)] + [("en", 1, datetime(2020, 1, 3, 12), 90)], "languageCode string, page_id long, visit_time timestamp, count int")
    store = ZScoreStore(spark, str(tmp_path / "z"), FIRST, 24, 3.0, 0.1)
    store.extend(v, FIRST, day(1))
    store.extend(V.in_period(v, day(2), day(2)), day(2), day(2))  # older visits are not even given
    assert {(r.hour, r.mark) for r in store.marks(day(1), day(2)).collect()} == {(60, 1)}


def test_peaks_of_the_tables(spark):
    """The query against trends and the recurrence, step by step."""
    import os

    import duckdb

    from quire import queries as Q

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = duckdb.sql(f"SELECT user_id % 25 AS p, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS h, count(*) AS n FROM '{sf}/events.parquet' GROUP BY ALL").fetchall()
    grid = np.zeros((25, 720))
    for p, h, n in rows:
        grid[p, h] = n
    want = {p: sum(m > 0 for m in slow_zscore(trend, 72, 3.0, 0.01)[240:]) for p, trend in enumerate(X.stl_trend(grid))}
    got = {r.page_id: r.active_hours for r in Q.QUERIES["zscore_peaks"](spark, sf).collect()}
    assert got == {p: n for p, n in want.items() if n} and len(got) > 10
