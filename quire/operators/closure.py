"""Where chains of redirects end, and what lies above a category, to any depth.

Both run in rounds, each a table in the shared scratch folder, which cuts the
lineage; a round joins what is still open with one row per page, so nothing is
gathered per page and the plan of a round does not grow. The driver sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.scratch import written


def _language(*tables: DataFrame) -> list[str]:
    return ["languageCode"] if all("languageCode" in t.columns for t in tables) else []


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def redirect_closure(redirects: DataFrame, scratch: str | None = None) -> DataFrame:
    """(from, id, hops, cycle, in_cycle[, languageCode]) of every redirect (from, id).

    id is the page that the chain ends at, after so many hops. A chain that runs
    into a cycle ends nowhere: id and hops are null and cycle is the smallest page
    id of that cycle; in_cycle tells the cycle's own pages from those that lead to
    it. A page with several redirects follows the one to the smallest id; rows
    with a null end are dropped.

    Pointers double: each round takes a page as far again as it has come, so a
    chain of n hops is done after log n rounds. If a round finishes no page, no
    page that is left ever will: a page at any distance would have one nearer to
    the end before it. What is left doubles on until it has gone round.
    """
    language = _language(redirects)
    keys = ["from", *language]
    first = redirects.where("`from` IS NOT NULL AND id IS NOT NULL").groupBy(*keys).agg(F.min(F.col("id").cast("long")).alias("at"))
    sources = first.select(F.col("from").alias("at"), *language, F.lit(True).alias("more"))
    now = first.join(sources, ["at", *language], "left").select(F.col("from").cast("long").alias("from"), *language, "at", F.lit(1).cast("long").alias("hops"), F.col("from").cast("long").alias("low"), F.col("more").isNull().alias("done"))
    open_, ended = written(now, "redirects", scratch), []

    def further(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows that are not done, on from where they point to by what is known from there."""
        ahead = known.select(F.col("from").alias("at"), *language, F.col("at").alias("to"), F.col("hops").alias("more_hops"), F.col("low").alias("more_low"), F.col("done").alias("to_done"))
        ahead = rows.where("NOT done").join(ahead, ["at", *language])
        return ahead.select("from", *language, F.col("to").alias("at"), (F.col("hops") + F.col("more_hops")).alias("hops"), F.least("low", "more_low").alias("low"), F.col("to_done").alias("done"))

    reach = 1
    while True:
        n_done, n_open = open_.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if n_done:
            ended.append(open_.where("done"))
        if not n_open or not n_done:
            break
        open_, reach = written(further(open_, _union([*ended, open_.where("NOT done")])), "redirects", scratch), 2 * reach
    found = [p.select("from", *language, F.col("at").alias("id"), "hops", F.lit(None).cast("long").alias("cycle"), F.lit(False).alias("in_cycle")) for p in ended]
    if n_open:
        # Nobody is ever done here. A tail and its cycle together have no more pages than are left.
        rings = open_.where("NOT done")
        while reach < n_open:
            rings, reach = written(further(rings, rings), "redirects", scratch), 2 * reach
        # All pointers stand on a cycle now, and each of its pages is pointed to by another of them.
        own = rings.select(F.col("at").alias("from"), *language).distinct().join(rings, keys).select(F.col("from").alias("at"), *language, F.col("low").alias("cycle"))
        rings = rings.join(own, ["at", *language])
        marks = own.select(F.col("at").alias("from"), *language, F.lit(True).alias("ring"))
        rings = rings.join(marks, keys, "left")
        found.append(rings.select("from", *language, F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("hops"), "cycle", F.coalesce("ring", F.lit(False)).alias("in_cycle")))
    if not found:
        return open_.select("from", *language, F.col("at").alias("id"), "hops", F.lit(None).cast("long").alias("cycle"), F.lit(False).alias("in_cycle"))
    return _union(found).select("from", "id", "hops", "cycle", "in_cycle", *language)


def ancestry(links: DataFrame, wanted: DataFrame | None = None, hops: int | None = None, scratch: str | None = None) -> DataFrame:
    """(id, ancestor, depth): every page and category that it belongs to over any number of links (from, id), by the fewest.

    wanted (column id) keeps the ancestors to some categories, from which the
    rounds go down; hops bounds the depth. A category on a cycle is its own
    ancestor. Each round extends only what the last one found, less all pairs
    that were found before, so that cycles come to an end.
    """
    language = _language(links) if wanted is None else _language(links, wanted)
    step = links.where("`from` IS NOT NULL AND id IS NOT NULL").select(F.col("from").cast("long").alias("id"), F.col("id").cast("long").alias("ancestor"), *language).distinct()
    step = written(step, "steps", scratch)
    start = step if wanted is None else step.join(wanted.select(F.col("id").cast("long").alias("ancestor"), *language), ["ancestor", *language], "left_semi")
    near = written(start.select("id", "ancestor", *language, F.lit(1).alias("depth")), "near", scratch)
    parts = [near]
    down = step.select(F.col("id").alias("below"), F.col("ancestor").alias("id"), *language)
    keys = ["id", "ancestor", *language]
    depth = 1
    while (hops is None or depth < hops) and not near.isEmpty():
        depth += 1
        more = down.join(near.select(*keys), ["id", *language]).select(F.col("below").alias("id"), "ancestor", *language).distinct()
        near = written(more.join(_union(parts).select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)), "near", scratch)
        parts.append(near)
    return _union(parts).select("id", "ancestor", "depth", *language)
