"""Components of a graph that grows: labels and sizes that new edges are worked into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import connected_components, dealt
from quire.scratch import written


@dataclass
class Components:
    """labels: (id, component), component being the smallest id reachable; sizes: (component, size)."""

    labels: DataFrame
    sizes: DataFrame

    def largest(self) -> DataFrame:
        """(component, size) of the largest, from the sizes alone; ties go to the lowest id, and nothing gives nothing."""
        return self.sizes.orderBy(F.desc("size"), "component").limit(1)


def begin(vertices: DataFrame, edges: DataFrame, scratch: str | None = None) -> Components:
    """Components from nothing; ends of edges that are no vertices count too."""
    ids = vertices.select(F.col("id").cast("long").alias("id")).unionByName(_ends(edges)).where("id IS NOT NULL").distinct()
    labels = written(connected_components(ids, edges, scratch), "labels", scratch)
    return Components(labels, written(labels.groupBy("component").agg(F.count("*").alias("size")), "sizes", scratch))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id"))


def extend(known: Components, edges: DataFrame, vertices: DataFrame | None = None, scratch: str | None = None) -> Components:
    """known with further edges (and vertices), as begin() has them of the whole.

    Each end of a new edge becomes the label of the component that it lies in. The
    graph of these labels has no more edges than there are new ones; its components
    say which old ones have become one, and old edges are not read. Labels and
    sizes are passed through once, to change those of components that were joined.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    ids = _ends(edges) if vertices is None else _ends(edges).unionByName(vertices.select(F.col("id").cast("long").alias("id")))
    fresh = written(ids.where("id IS NOT NULL").distinct().join(dealt(known.labels), "id", "left_anti"), "fresh", scratch)
    labels = known.labels.unionByName(fresh.select("id", F.col("id").alias("component")))
    pairs = edges.where("src <> dst")
    for end in ("src", "dst"):
        pairs = pairs.join(dealt(labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_label"))), end)
    pairs = written(pairs.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).where("src <> dst").distinct(), "contracted", scratch)
    found = connected_components(_ends(pairs).distinct(), pairs, scratch)
    # Only labels that are not the smallest of their new component change.
    moved = written(found.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("to")), "moved", scratch)
    labels = labels.join(dealt(moved), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    sizes = known.sizes.unionByName(fresh.select(F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))).join(dealt(moved), "component", "left")
    sizes = sizes.groupBy(F.coalesce("to", "component").alias("component")).agg(F.sum("size").alias("size"))
    return Components(written(labels, "labels", scratch), written(sizes, "sizes", scratch))
