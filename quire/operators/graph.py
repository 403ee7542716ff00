"""Property graphs as two tables: vertices (id, ...) and edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.scratch import written


def dealt(df: DataFrame) -> DataFrame:
    """df as the side of a join that is dealt out by its key, whatever size Spark takes it for.

    Spark takes a table for as large as its files, and series and ids lie in these at a
    tenth or a hundredth of what they need in memory: it would send them whole, through the driver.
    """
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """The same for wide rows with a key of their own: each task hashes its share, and what is joined with it is not sorted."""
    return df.hint("shuffle_hash")


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def without_singletons(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(dealt(endpoints(edges)), "id", "left_semi")


def prune_edges(edges: DataFrame, min_weight: float) -> DataFrame:
    """Edges above min_weight; a weight that is null or not a number is not above anything."""
    return edges.where(F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double")) & (F.col("weight") > min_weight))


def undirected(edges: DataFrame, merge=F.sum) -> DataFrame:
    """One edge for each pair of ids, the lower first; merge joins the weights. Self loops stay."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(merge("weight").alias("weight"))


def induced(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on the ids (column id): both ends of an edge have to be among them."""
    inside = edges.join(dealt(ids.select(F.col("id").alias("src"))), "src", "left_semi").join(dealt(ids.select(F.col("id").alias("dst"))), "dst", "left_semi")
    return vertices.join(dealt(ids.select("id")), "id", "left_semi"), inside.select(edges.columns)


def active_subgraph(pages: DataFrame, links: DataFrame, active: DataFrame, category_links: DataFrame | None = None, include_categories: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, title), edges (src, dst, weight 1)) on the active pages.

    links are (from, dest); category_links (from, id) are further edges when
    categories are included. Titles are escaped for XML.
    """
    kept = pages if include_categories else pages.where(F.col("namespace") != 14)
    nodes = kept.join(dealt(active.select(F.col("page_id").alias("id"))), "id", "left_semi").select("id", xml_escape(F.col("title")).alias("title"))
    every = links.select(F.col("from").alias("src"), F.col("dest").alias("dst"))
    if include_categories and category_links is not None:
        every = every.unionByName(category_links.select(F.col("from").alias("src"), F.col("id").alias("dst")))
    _, edges = induced(nodes, every, nodes)
    return nodes, edges.select("src", "dst", F.lit(1.0).alias("weight"))


def with_attributes(vertices: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Vertices with what another table has for them, null where it has nothing."""
    return vertices.join(looked_up(attributes.withColumnRenamed(key, "id")), "id", "left")


def triplets(vertices: DataFrame, edges: DataFrame, *attributes: str) -> DataFrame:
    """Edges with attributes of both ends, as src_<name> and dst_<name>."""
    rows = edges
    for end in ("src", "dst"):
        side = vertices.select(F.col("id").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in attributes])
        rows = rows.join(looked_up(side), end)
    return rows


def connected_components(vertices: DataFrame, edges: DataFrame, scratch: str | None = None) -> DataFrame:
    """(id, component): component is the smallest id reachable. Runs a few jobs.

    Stars are contracted in turns until nothing changes; a path of n vertices needs
    about log n rounds. Every round is a table in the shared checkpoint folder (or scratch),
    which cuts the lineage. Vertices without edges are their own component.
    """
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    now = written(pairs.select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v")).distinct(), "stars", scratch)
    before = after = None
    while before is None or (after != before and after[0]):
        before = after or ()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars", scratch)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    labels = now.groupBy("u").agg(F.min("v").alias("m"))
    return vertices.select("id").distinct().join(dealt(labels), F.col("id") == F.col("u"), "left").select("id", F.coalesce("m", F.col("id").cast("long")).alias("component"))


def largest_component(components: DataFrame) -> DataFrame:
    """(component, size) of the largest; ties go to the lowest id, and nothing gives nothing."""
    return components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


def largest_component_graph(vertices: DataFrame, edges: DataFrame, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the largest component."""
    found = connected_components(vertices, edges, scratch)
    ids = found.join(F.broadcast(largest_component(found).select("component")), "component", "left_semi").select("id")
    return induced(vertices, edges, ids)


def xml_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def gexf_elements(vertices: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(part, a, b, line): the XML element of every vertex (part 0) and edge (part 1)."""
    node = F.concat(F.lit('      <node id="'), F.col("id"), F.lit('" label="'), F.col("title"), F.lit('" />'))
    weight = F.col("weight").cast("string")
    parts = [F.lit('        <edge source="'), F.col("src"), F.lit('" target="'), F.col("dst"), F.lit('" label="'), weight]
    parts += [F.lit('" weight="'), weight] if weighted else []
    nodes = vertices.select(F.lit(0).alias("part"), F.col("id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("line"))
    return nodes.unionByName(edges.select(F.lit(1).alias("part"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.concat(*parts, F.lit('" />')).alias("line")))
