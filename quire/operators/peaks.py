"""Pages with unusual activity, and the graph of those that were active together."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import series as X
from quire.functions import sketch as K
from quire.functions.dates import period_hours
from quire.operators import days as Y
from quire.operators import graph as G
from quire.operators import visits as V
from quire.scratch import written


def burst_pages(visits: DataFrame, history: date, start: date, end: date, burst_rate: float, burst_count: int) -> DataFrame:
    """page_id with more than burst_count entries above mean + burst_rate deviations.

    The threshold is of the period with its history; entries count from start on.
    """
    limits = V.thresholds(V.stats(V.in_period(visits, history, end), history, end), burst_rate)
    rows = V.in_period(visits, start, end).join(G.dealt(limits), "page_id").where(F.col("count") > F.col("threshold"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > burst_count).select("page_id")


def zscore_pages(visits: DataFrame, history: date, start: date, end: date, lag: int, threshold: float, influence: float, min_hours: int) -> DataFrame:
    """(page_id, active_hours) of pages whose trend peaks in at least min_hours hours from start on."""
    skip = period_hours(history, start - timedelta(days=1)) if history < start else 0
    trends = V.dense(V.in_period(visits, history, end), history, end).select("page_id", X.trend_of("values").alias("trend"))
    hours = X.active_hours_of(lag, threshold, influence, skip)
    return trends.select("page_id", hours("trend").alias("active_hours")).where(F.col("active_hours") >= min_hours)


def active_series(visits: DataFrame, active: DataFrame, start: date, end: date, daily_min: int, days: DataFrame | None = None) -> DataFrame:
    """(page_id, values): hourly series of the active pages that have a day of at least daily_min visits.

    days, the table of day statistics, says so without a pass over the visits.
    """
    own = V.in_period(visits, start, end)
    if days is not None:
        maxima = Y.daily_maximum(days.join(G.dealt(active.select("page_id")), "page_id", "left_semi"), start, end)
    else:
        own = own.join(G.dealt(active.select("page_id")), "page_id", "left_semi")
        maxima = V.daily_maximum(own, start, end)
    return V.dense(own.join(G.dealt(maxima.where(F.col("daily_max") >= daily_min)), "page_id", "left_semi"), start, end)


def shapes_of(series: DataFrame, hours: int, correlation: bool = True, filtered: bool = False) -> DataFrame:
    """(page_id, shape): what the likeness of two pages is taken from, once per page, not per edge.

    For correlation that is the standardised trend, else the trend clipped at 0 (divided by hours if filtered).
    """
    if correlation:
        return series.select("page_id", X.standard_trend_of("values").alias("shape"))
    scale = float(hours) if filtered else 1.0
    ready = series.select("page_id", X.trend_of("values").alias("trend"))
    return ready.select("page_id", F.transform("trend", lambda v: F.greatest(v / scale, F.lit(0.0))).alias("shape"))


def _likeness(a: Column, b: Column, hours: int, correlation: bool, least: float) -> Column:
    if correlation:
        return _correlation(X.packed(a), b, X.total(b), hours)
    return F.nanvl(F.when(a.isNull() | b.isNull(), 0.0).otherwise(X.ratio_similarity(a, b, least)), F.lit(0.0))


def _correlation(a: Column, b: Column, total_b: Column, hours: int) -> Column:
    """The likeness of a packed shape and a whole one, whose total is given."""
    weight = F.greatest(X.packed_dot(a, b, total_b), F.lit(0.0)) * hours
    return F.nanvl(F.when(a.isNull() | b.isNull(), 0.0).otherwise(weight), F.lit(0.0))


def edge_similarity(vertices: DataFrame, edges: DataFrame, series: DataFrame, hours: int, correlation: bool = True, filtered: bool = False, least: float = 0.5) -> DataFrame:
    """Edges weighted by the likeness of their ends' series, 0 where one has none.

    Correlation is that of the trends, clipped at 0, times hours; else it is the
    sum of the hourly ratios of the trends (see shapes_of) above least.
    """
    return weighted(vertices, edges, shapes_of(series, hours, correlation, filtered), hours, correlation, least)


def weighted(vertices: DataFrame, edges: DataFrame, shapes: DataFrame, hours: int, correlation: bool = True, least: float = 0.5) -> DataFrame:
    """The same from shapes; both shapes go with every edge."""
    rows = G.triplets(G.with_attributes(vertices.select("id"), shapes, "page_id"), edges, "shape")
    return rows.select("src", "dst", _likeness(F.col("src_shape"), F.col("dst_shape"), hours, correlation, least).alias("weight"))


def with_sketches(shapes: DataFrame, correlation: bool = True, width: int = K.SEGMENT_HOURS) -> DataFrame:
    """(page_id, shape, sketch), to be written once: the first pass over edges reads the sketches alone."""
    sketch = K.shape_sketch if correlation else K.ratio_sketch
    return shapes.select("page_id", "shape", sketch(F.col("shape"), width).alias("sketch"))


def possible_edges(vertices: DataFrame, edges: DataFrame, sketched: DataFrame, hours: int, min_weight: float, correlation: bool = True, least: float = 0.5) -> DataFrame:
    """(src, dst) of the edges whose sketches allow a weight above min_weight (at least 0)."""
    known = vertices.select("id").join(G.looked_up(sketched.select(F.col("page_id").alias("id"), "sketch")), "id")
    # By id alone first: no edge carries a sketch to a page that has none.
    inside = edges.select("src", "dst").join(G.looked_up(known.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst")
    rows = G.triplets(known, inside, "sketch")
    a, b = F.col("src_sketch"), F.col("dst_sketch")
    bound = K.dot_bound(a, b) * hours if correlation else K.ratio_bound(a, b, least)
    return rows.where(bound > min_weight).select("src", "dst")


def similar_edges(vertices: DataFrame, edges: DataFrame, sketched: DataFrame, hours: int, min_weight: float, correlation: bool = True, least: float = 0.5) -> DataFrame:
    """The edges of weighted() above min_weight, the same in every value.

    Only edges whose sketches allow such a weight fetch the two series; the others
    move a sketch of a value or three for each segment. Below 0 every edge counts,
    and there is nothing to prune.
    """
    shapes = sketched.select("page_id", "shape")
    if min_weight < 0:
        return G.prune_edges(weighted(vertices, edges, shapes, hours, correlation, least), min_weight)
    some = possible_edges(vertices, edges, sketched, hours, min_weight, correlation, least)
    # The src series goes with every edge: only the hours do in which it differs from its least value.
    src, dst = shapes.withColumnRenamed("page_id", "src"), shapes.withColumnRenamed("page_id", "dst")
    if correlation:
        rows = some.join(G.looked_up(src.select("src", X.packed(F.col("shape")).alias("src_shape"))), "src")
        rows = rows.join(G.looked_up(dst.select("dst", F.col("shape").alias("dst_shape"), X.total(F.col("shape")).alias("dst_total"))), "dst")
        weight = _correlation(F.col("src_shape"), F.col("dst_shape"), F.col("dst_total"), hours)
    elif least < 0:
        rows = G.triplets(shapes.withColumnRenamed("page_id", "id"), some, "shape")
        weight = _likeness(F.col("src_shape"), F.col("dst_shape"), hours, correlation, least)
    else:
        # Or those other than 0, as the rest add nothing.
        rows = some.join(G.looked_up(src.select("src", X.sparse(F.col("shape")).alias("src_shape"))), "src").join(G.looked_up(dst.select("dst", F.col("shape").alias("dst_shape"))), "dst")
        weight = F.nanvl(F.coalesce(X.sparse_ratio_similarity(F.col("src_shape"), F.col("dst_shape"), least), F.lit(0.0)), F.lit(0.0))
    return G.prune_edges(rows.select("src", "dst", weight.alias("weight")), min_weight)


def peak_graph(vertices: DataFrame, edges: DataFrame, series: DataFrame, hours: int, min_weight: float = 1.0, correlation: bool = True, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The largest component of the active subgraph, edges weighted by the likeness of trends and pruned."""
    return peak_graph_of(vertices, edges, shapes_of(series, hours, correlation), hours, min_weight, correlation, scratch)


def peak_graph_of(vertices: DataFrame, edges: DataFrame, shapes: DataFrame, hours: int, min_weight: float = 1.0, correlation: bool = True, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same from shapes (page_id, shape), such as those of the series themselves."""
    pairs = G.undirected(edges, F.max)
    # Shapes are the costly part, and two passes read them: sketches of all, series of few.
    sketched = written(with_sketches(shapes, correlation), "sketched", scratch)
    found = written(similar_edges(vertices, pairs, sketched, hours, min_weight, correlation), "weighted", scratch)
    return G.largest_component_graph(G.without_singletons(vertices, found), found, scratch)
