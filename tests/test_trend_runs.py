"""Trends taken by runs of places, and from Arrow's buffers."""

import numpy as np
import pyarrow as pa
import pytest

from quire.functions import series as X


@pytest.mark.parametrize("n, width", [(40, 37), (75, 37), (76, 37), (200, 25), (720, 37)])
def test_runs_are_the_sums_of_each_place(n, width):
    x = np.random.default_rng(n).random((3, n))
    fit = X.Smoother(n, width, 1)
    # Was a matrix of one place, applied place by place.
    assert fit.band.shape == (2 * fit.q - 1, 3 * fit.q)
    found = fit.sums(x, 3)
    for k in range(n):
        off = np.arange(fit.first[k], fit.first[k] + fit.q) - k
        near = (1 - (np.abs(off) / np.abs(off).max()) ** 3).clip(0) ** 3
        for p in range(3):
            assert np.allclose(found[p, :, k], (x[:, fit.first[k] : fit.first[k] + fit.q] * near * off**p).sum(1), atol=1e-9)


def test_series_stay_in_arrow():
    rng = np.random.default_rng(1)
    rows = [rng.random(n).tolist() for n in (100, 120, 100, 10)] + [None, []]
    rows += [rng.random(100).tolist() for _ in range(40)]
    got = X._series_of(pa.array(rows, pa.list_(pa.float64())), X.stl_trend)
    assert isinstance(got, pa.ListArray) and got[4].as_py() is None and got[5].as_py() == []
    for row, trend in zip(rows, got.to_pylist(), strict=True):
        if row:
            assert np.allclose(trend, X.stl_trend(np.array(row)), rtol=0, atol=1e-9)
    assert X._series_of(pa.array([[]], pa.list_(pa.float64())), X.stl_trend, empty=False).to_pylist() == [None]
