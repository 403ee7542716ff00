"""Short sketches of hourly series, and what two of them say at most about the series' likeness.

A bound is never below the likeness itself: pairs whose bound is too low need no
look at their series, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours of a segment.
SEGMENT_HOURS = 24
#: Added to the square of what a sketch leaves out, for series of length up to 1; rounding is far below.
SLACK = 1e-12


def _segments(values: Column, width: int) -> Column:
    """The values in runs of width; the last may be shorter."""
    count = F.ceil(F.size(values) / width).cast("int")
    # sequence(0, -1) would count down.
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda j: F.slice(values, j * width + 1, F.lit(width)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def shape_sketch(shape: Column, width: int = SEGMENT_HOURS) -> Column:
    """struct(head, rest) of a series of length (norm) 1 or 0.

    head: its coordinates along the unit vectors that are constant on one segment
    and 0 elsewhere; rest: the length of what is orthogonal to all of them.
    """
    head = F.transform(_segments(shape, width), lambda s: _sum(s) / F.sqrt(F.size(s)))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    return F.struct(head.alias("head"), F.sqrt(F.greatest(square(shape) - square(head), F.lit(0.0)) + SLACK).alias("rest"))


def dot_bound(a: Column, b: Column) -> Column:
    """At least the dot product of two sketched series: heads agree exactly, rests at best in full (Cauchy-Schwarz)."""
    heads = F.zip_with(a["head"], b["head"], lambda x, y: x * y)
    return F.aggregate(heads, F.lit(0.0), lambda s, v: s + v) + a["rest"] * b["rest"] + SLACK


def ratio_sketch(values: Column, width: int = SEGMENT_HOURS) -> Column:
    """array of struct(n, low, high): how many hours of each segment are above 0, and between what values."""
    positive = lambda s: F.filter(s, lambda v: v > 0)
    return F.transform(_segments(values, width), lambda s: F.struct(F.size(positive(s)).alias("n"), F.array_min(positive(s)).alias("low"), F.array_max(positive(s)).alias("high")))


def ratio_bound(a: Column, b: Column, least: float = 0.5) -> Column:
    """At least the ratio similarity of two sketched series without values below 0.

    An hour counts if both are above 0, and then at most the largest ratio that the
    segment's ranges allow; a segment whose ranges lie too far apart counts nothing.
    """

    def most(x: Column, y: Column) -> Column:
        best = F.least(F.lit(1.0), x["high"] / y["low"], y["high"] / x["low"])
        return F.when((x["n"] > 0) & (y["n"] > 0) & (best > least), F.least(x["n"], y["n"]) * best).otherwise(0.0)

    return F.aggregate(F.zip_with(a, b, most), F.lit(0.0), lambda s, v: s + v) * (1 + SLACK)
