"""Smoothed z-scores of hourly series by running sums, with a state that goes on.

Mean and spread of the window slide by one value an hour. They are taken anew from
the window at every hour whose number is a multiple of lag, and wherever most of
the spread has just left, so that rounding does not add up. When they are taken
anew depends on a series' own hours alone: a series that is cut anywhere and gone
on with has the very numbers of one that is read at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What is no more than this, against the largest value so far or one visit, is rounding.
ROUNDING = 1e-9
#: A spread that falls to less than this share of what it was is taken anew.
LEFT = 1e-6


@dataclass
class ZScores:
    """The state of several series that have seen equally many hours.

    tail: the damped values of the last lag + 1 judged hours (fewer at the start);
    mean, square: of the window that the next hour is judged by, square being the
    sum of squared distances from mean; largest: the largest value so far; last:
    the newest hour, which is judged when the next one comes.
    """

    lag: int
    seen: int
    tail: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    largest: np.ndarray
    last: np.ndarray

    @classmethod
    def of_zeros(cls, lag: int, seen: int, n: int) -> ZScores:
        """The state of n series after so many hours without visits; zeros are never marked."""
        if lag < 2:
            raise ValueError("the window needs at least two hours")
        zero = np.zeros(n)
        return cls(lag, seen, np.zeros((n, tail_size(lag, seen))), zero, zero.copy(), zero.copy(), zero.copy())

    def extend(self, values: np.ndarray, threshold: float, influence: float) -> np.ndarray:
        """Take in further hours (columns of values), and judge all but the newest.

        Returns the marks, +1, -1 or 0, of the hours from the one that was pending on
        (from hour 0, if there was none): as many as values has columns, less one at the start.
        """
        lag, first = self.lag, max(self.seen - 1, 0)
        y = np.asarray(values, np.float64)
        if not y.shape[1]:
            return np.zeros(y.shape, np.int32)
        if self.seen:
            y = np.concatenate([self.last[:, None], y], 1)
        held, judged = self.tail.shape[1], y.shape[1] - 1
        calm = np.concatenate([self.tail, np.empty((len(y), judged))], 1)
        mean, square, largest = self.mean.copy(), self.square.copy(), self.largest.copy()
        marks = np.zeros((len(y), judged), np.int32)
        for k in range(judged):
            i, now, at = first + k, y[:, k], held + k
            largest = np.maximum(largest, np.abs(now))
            if i < lag:
                calm[:, at] = now
                continue
            # The window of hour i ends before hour i - 1; the first two hours share one.
            window = calm[:, max(at - lag - 1, 0) : max(at - 1, lag)] if i > lag else calm[:, at - lag : at]
            if i > lag + 1 and i % lag:
                old, new = calm[:, at - lag - 2], calm[:, at - 2]
                before, middle = square, mean + (new - old) / lag
                square = np.maximum(square + (new - old) * (new - middle + old - mean), 0.0)
                mean = middle
                if (anew := np.flatnonzero(square < LEFT * before)).size:
                    mean[anew], square[anew] = _sums(window[anew])
            elif i != lag + 1 or not i % lag:
                mean, square = _sums(window)
            spread = np.sqrt(square / (lag - 1))
            out = np.abs(now - mean) > np.maximum(threshold * spread * (1 + ROUNDING), ROUNDING * np.maximum(1.0, largest))
            marks[:, k] = np.where(out, np.where(now > mean, 1, -1), 0)
            calm[:, at] = np.where(out, influence * now + (1 - influence) * calm[:, at - 1], now)
        self.seen += values.shape[1]
        self.tail = calm[:, calm.shape[1] - tail_size(lag, self.seen) :]
        self.mean, self.square, self.last = mean, square, y[:, -1].copy()
        self.largest = largest
        return marks


def tail_size(lag: int, seen: int) -> int:
    """Damped values that are kept: those of the judged hours, up to lag and the one that leaves next and the newest."""
    return min(max(seen - 1, 0), lag + 2)


def _sums(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = window.mean(1)
    return mean, ((window - mean[:, None]) ** 2).sum(1)


def smoothed_zscore(y: np.ndarray, lag: int, threshold: float, influence: float) -> np.ndarray:
    """+1 or -1 for each hour that leaves the band of the lag hours before it, else 0.

    The first lag hours and the last one are never marked. A marked hour enters
    the running window damped by influence; the window of an hour ends before it.
    y may hold several series of one length, one in each row: they go hour by hour
    together. An hour on the edge of its band is inside; what is no more than
    rounding, against the series' largest value or one visit, leaves no band.
    """
    y = np.asarray(y, np.float64)
    signal = np.zeros(y.shape, np.int32)
    n = y.shape[-1]
    if n <= lag or lag < 2:
        return signal
    rows = y.reshape(-1, n)
    state = ZScores.of_zeros(lag, 0, len(rows))
    state.largest = np.abs(rows).max(1)
    signal.reshape(-1, n)[:, :-1] = state.extend(rows, threshold, influence)
    return signal
