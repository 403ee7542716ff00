"""Hourly series: similarity, correlation, trend and peaks.

The column forms stay in Spark's expressions. The numpy forms, for what is
recursive or iterative, run in Arrow batches and take many series at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.zscore import smoothed_zscore


def ratio_similarity(a: Column, b: Column, least: float = 0.5) -> Column:
    """Sum of min/max over the hours where that is above least; 0/0 counts as nothing."""
    ratio = F.zip_with(a, b, lambda x, y: F.try_divide(F.least(x, y), F.greatest(x, y)))
    return F.aggregate(F.filter(ratio, lambda r: ~F.isnan(r) & (r > least)), F.lit(0.0), lambda s, r: s + r)


def sparse(a: Column) -> Column:
    """struct(at, values): the hours of a series that are neither 0 nor null, and what they hold."""
    pairs = F.filter(F.transform(a, lambda v, i: F.struct(i.alias("at"), v.alias("v"))), lambda p: p["v"] != 0)
    # In an array of one, so that the pairs are made once for both fields.
    return F.get(F.transform(F.array(pairs), lambda p: F.struct(F.transform(p, lambda x: x["at"]).alias("at"), F.transform(p, lambda x: x["v"]).alias("values"))), 0)


def sparse_ratio_similarity(a: Column, b: Column, least: float = 0.5) -> Column:
    """ratio_similarity of a sparse series and a whole one, for least from 0 on: hours of 0 never count there."""
    ratio = F.zip_with(a["at"], a["values"], lambda at, x: F.try_divide(F.least(x, F.get(b, at)), F.greatest(x, F.get(b, at))))
    return F.aggregate(F.filter(ratio, lambda r: ~F.isnan(r) & (r > least)), F.lit(0.0), lambda s, r: s + r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def packed(a: Column) -> Column:
    """struct(n, base, at, values): the hours of a series of n that differ from its least value, base, and by how much.

    Where that takes more room than the series, at is null and values holds it whole.
    """

    def pairs(m: Column) -> Column:
        return F.filter(F.transform(a, lambda v, i: F.struct(i.alias("at"), (v - m["base"]).alias("v"))), lambda p: ~p["v"].eqNullSafe(F.lit(0.0)))

    def row(x: Column) -> Column:
        few = F.size(x["pairs"]) * 12 <= F.size(a) * 8  # bytes of an hour and its value, and of a value
        return F.struct(
            F.size(a).alias("n"), x["base"].alias("base"), F.when(few, F.transform(x["pairs"], lambda p: p["at"])).alias("at"),
            F.when(few, F.transform(x["pairs"], lambda p: p["v"])).otherwise(a).alias("values"),
        )

    # In arrays of one, so that base is found once for all values, and pairs are made once for all fields.
    least = F.array(F.struct(F.coalesce(F.array_min(a), F.lit(0.0)).alias("base")))
    known = F.transform(least, lambda m: F.struct(m["base"].alias("base"), pairs(m).alias("pairs")))
    return F.when(a.isNotNull(), F.get(F.transform(known, row), 0))


def packed_dot(a: Column, b: Column, total_b: Column) -> Column:
    """The dot product of a packed series and a whole one, whose total is given; null if lengths differ."""
    more = F.aggregate(F.zip_with(a["at"], a["values"], lambda at, v: v * F.get(b, at)), F.lit(0.0), lambda s, v: s + v)
    return F.when(a["at"].isNull(), dot(a["values"], b)).when(a["n"] == F.size(b), a["base"] * total_b + more)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two series of one length; 0 if either is constant, an error if lengths differ.

    Five sums, each one pass: nothing is computed again inside a lambda.
    """
    n = F.when(F.size(a) == F.size(b), F.size(a).cast("double")).otherwise(F.raise_error(F.lit("series of different lengths")).cast("double"))
    sa, sb = total(a), total(b)
    va, vb = n * dot(a, a) - sa * sa, n * dot(b, b) - sb * sb
    return F.when((va > 0) & (vb > 0), (n * dot(a, b) - sa * sb) / F.sqrt(va * vb)).otherwise(0.0)


def standard(a: Column) -> Column:
    """A series less its mean, by its length in that space; zeros for a constant one. The dot product of two is their correlation.

    The sums are exact for whole numbers, so that a constant series of counts is found constant.
    """
    n, s = F.size(a).cast("double"), total(a)
    spread = n * dot(a, a) - s * s
    # The sums stand in an array of one, so that they are not taken again for every value.
    sums = F.array(F.struct(F.try_divide(s, n).alias("mean"), F.when(spread > 0, F.sqrt(spread / n)).alias("length")))
    return F.get(F.transform(sums, lambda m: F.transform(a, lambda v: F.coalesce((v - m["mean"]) / m["length"], F.lit(0.0)))), 0)


class Smoother:
    """Local regression of n evenly spaced values, at their places and as many before and after as asked for.

    A fit is a ratio of weighted sums over the places near by, and these sums are
    products with matrices that depend on the places alone. Inside, all places
    have the same neighbours and share one small matrix; near the ends, and where
    a window holds all values, each place has a column of its own. Places with
    the same neighbours are taken in runs of a window's length: the windows of a
    run lie in one stretch of values, and the run is one product with a band matrix.
    """

    def __init__(self, n: int, width: int, degree: int, before: int = 0, after: int = 0):
        self.n, self.degree = n, degree
        q = self.q = min(width, n)
        at = np.arange(-before, n + after, dtype=np.float64)
        first = np.clip(np.round(at).astype(int) - (q - 1) // 2, 0, n - q)
        off = first[:, None] + np.arange(q) - at[:, None]
        reach = np.maximum(np.abs(off).max(1) + max(width - n, 0) // 2 + 1e-12, 1.0)
        near = np.clip(1 - (np.abs(off) / reach[:, None]) ** 3, 0, None) ** 3
        moments = np.stack([near, near * off, near * off * off])  # (3, places, q)
        self.head, self.tail = np.flatnonzero(first == 0), np.flatnonzero(first == n - q)
        if q == n:
            self.tail = self.tail[:0]
        inner = np.flatnonzero((first > 0) & (first < n - q))
        self.inner, self.first = inner, first
        self.ends = [(k, moments[:, k].transpose(2, 0, 1).reshape(q, -1)) for k in (self.head, self.tail)]
        # (2q - 1, 3q): the sums of a run from its stretch of values, by power and place.
        self.band = None
        if len(inner):
            self.band = np.zeros((2 * q - 1, 3, q))
            for i in range(q):
                self.band[i : i + q, :, i] = moments[:, inner[0]].T
            self.band = self.band.reshape(2 * q - 1, -1)
        self.places = len(at)

    def sums(self, x: np.ndarray, powers: int) -> np.ndarray:
        """(powers, series, places): sums of x near each place, by powers of the distance."""
        out = np.empty((powers, len(x), self.places))
        for (k, matrix), part in zip(self.ends, (x[:, : self.q], x[:, self.n - self.q :]), strict=True):
            if len(k):
                out[:, :, k[0] : k[-1] + 1] = (part @ matrix[:, : powers * len(k)]).reshape(len(x), powers, len(k)).transpose(1, 0, 2)
        if self.band is not None:
            q, start, places = self.q, self.first[self.inner[0]], len(self.inner)
            runs = -(-places // q)
            padded = np.zeros((len(x), (runs + 1) * q - 1))
            padded[:, : places + q - 1] = x[:, start : start + places + q - 1]
            stretches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 2 * q - 1, axis=1)[:, ::q]).reshape(-1, 2 * q - 1)
            found = (stretches @ self.band[:, : powers * q]).reshape(len(x), runs, powers, q).transpose(2, 0, 1, 3).reshape(powers, len(x), runs * q)
            out[:, :, self.inner[0] : self.inner[-1] + 1] = found[:, :, :places]
        return out

    def __call__(self, y: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The fit of each series (row of y), weighted by its rows of weights."""
        w = np.ones((1, self.n)) if weights is None else weights
        powers = 3 if self.degree else 1
        total, *more = self.sums(w, powers)
        fits = self.sums(y if weights is None else y * w, 2 if self.degree else 1)
        flat = total <= 1e-300
        safe = np.where(flat, 1.0, total)
        fit = fits[0] / safe
        if self.degree:
            middle = more[0] / safe
            spread = more[1] / safe - middle**2
            fit = fit - (fits[1] / safe - middle * fit) / np.where(spread > 1e-9, spread, np.inf) * middle
        if flat.any():
            fit = np.where(flat, self.means(y), fit)
        return fit

    def means(self, y: np.ndarray) -> np.ndarray:
        """The plain mean of the values near each place, for places whose neighbours all have no weight."""
        sums = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, 1)], 1)
        return (sums[:, self.first + self.q] - sums[:, self.first]) / self.q


@lru_cache(maxsize=64)
def smoother(n: int, width: int, degree: int, before: int = 0, after: int = 0) -> Smoother:
    return Smoother(n, width, degree, before, after)


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def _running_mean(x: np.ndarray, window: int) -> np.ndarray:
    sums = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
    return (sums[:, window:] - sums[:, :-window]) / window


def stl_trend(y: np.ndarray, period: int = 24, seasonal_width: int = 240, inner: int = 1, outer: int = 15, trend_width: int | None = None) -> np.ndarray:
    """The trend of a seasonal-trend decomposition by loess, robust to single hours.

    y may hold several series of one length, one in each row. A series of less
    than two periods, a constant one and one with a value that is not finite are
    returned as they are.
    """
    y = np.asarray(y, np.float64)
    if y.ndim == 1:
        return stl_trend(y[None], period, seasonal_width, inner, outer, trend_width)[0]
    out, n = y.copy(), y.shape[1]
    if n < 2 * period:
        return out
    todo = np.flatnonzero(np.isfinite(y).all(1) & (np.ptp(y, axis=1) != 0))
    seasonal_width = _odd(seasonal_width)
    trend_width = trend_width or _odd(1.5 * period / (1 - 1.5 / seasonal_width))
    low, long = smoother(n, _odd(period), 1), smoother(n, trend_width, 1)
    y = y[todo]
    trend, weights = np.zeros(y.shape), np.ones(y.shape)
    for turn in range(max(outer, 0) + 1):
        if not len(todo):
            break
        for _ in range(inner):
            rest = y - trend
            cycle = np.empty((len(y), n + 2 * period))
            # Hours of the day with the same number of values are smoothed together.
            for first, last in ((0, n % period), (n % period, period)):
                if first < last:
                    size = len(range(first, n, period))
                    hours = lambda x: np.stack([x[:, k::period] for k in range(first, last)], 1).reshape(-1, size)  # noqa: B023, E731
                    smoothed = smoother(size, seasonal_width, 1, 1, 1)(hours(rest), hours(weights)).reshape(len(y), last - first, size + 2)
                    for k in range(first, last):
                        cycle[:, k::period] = smoothed[:, k - first]
            smooth = cycle
            for window in (period, period, 3):
                smooth = _running_mean(smooth, window)
            season = cycle[:, period : period + n] - low(smooth)
            trend = long(y - season, weights)
        out[todo] = trend
        if turn < outer:
            off = np.abs(y - trend - season)
            h = 6 * np.median(off, axis=1, keepdims=True)
            live = h[:, 0] > 1e-12
            todo, y, trend, off, h = todo[live], y[live], trend[live], off[live], h[live]
            weights = np.where(off <= 0.001 * h, 1.0, np.where(off >= 0.999 * h, 0.0, (1 - np.minimum(off / h, 1) ** 2) ** 2))
    return out


#: Series that are decomposed together: their windows are in memory at once.
STACK = 32


def _stacked(values: pd.Series, work) -> pd.Series:
    """work on stacks of series of one length; it returns a row or a value for each. Null stays null."""
    out: list = [None] * len(values)
    by_length: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        if v is not None:
            by_length.setdefault(len(v), []).append(k)
    for own in by_length.values():
        for at in range(0, len(own), STACK):
            some = own[at : at + STACK]
            for k, found in zip(some, work(np.array([values.iloc[k] for k in some], np.float64)), strict=True):
                out[k] = found
    return pd.Series(out, dtype=object)


def _series_of(values: pa.Array, work, empty: bool = True) -> pa.Array:
    """The series that work makes of stacks of one length, straight from and to Arrow's buffers. Null stays null, and so do empty ones unless they may be."""
    size = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
    flat = pc.cast(values.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    out = np.empty(len(flat))
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        for at in range(0, len(own), STACK):
            places = ends[own[at : at + STACK], None] + np.arange(n)
            out[places] = work(flat[places])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, from_pandas=True), mask=pa.array(size < (0 if empty else 1)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def trend_of(values: pa.Array) -> pa.Array:
    """The trend of each hourly series: what is left without daily variation."""
    return _series_of(values, stl_trend)


def standardised(y: np.ndarray) -> np.ndarray:
    """Each series (row) less its mean, by its length in that space; zeros for a constant one."""
    middle = y - y.mean(-1, keepdims=True)
    length = np.linalg.norm(middle, axis=-1, keepdims=True)
    varies = length > 1e-12 * np.maximum(1.0, np.abs(y).max(-1, keepdims=True))
    return np.where(varies, middle / np.where(varies, length, 1.0), 0.0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def standard_trend_of(values: pa.Array) -> pa.Array:
    """The standardised trend of each series: the dot product of two is their correlation. An empty series is null."""
    return _series_of(values, lambda y: standardised(stl_trend(y)), empty=False)


def active_hours_of(lag: int, threshold: float, influence: float, skip: int):
    """A function of an hourly trend: its number of peaks after the first skip hours."""

    @F.pandas_udf(T.IntegerType())
    def count(values: pd.Series) -> pd.Series:
        return _stacked(values, lambda y: (smoothed_zscore(y, lag, threshold, influence)[:, skip:] > 0).sum(1).tolist())

    return count
