"""Connected components of a link table, by the graph operators' alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import connected_components


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (columns a, b): component is the smallest id reachable.

    Every round joins the links with one row per id, so an id with very many
    links is split by the adaptive skew join; nothing is gathered per id. Rounds
    are written tables. Self links are ignored but their ids are returned; null
    ends are dropped; an empty table gives an empty result.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select(a.alias("src"), b.alias("dst"))
    return connected_components(links.select(F.explode(F.array("src", "dst")).alias("id")), links)
