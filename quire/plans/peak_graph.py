"""Visits and a page graph to the graph of pages with unusual activity."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from quire import session
from quire.functions.dates import history_start, period_hours
from quire.operators import days as Y
from quire.operators import graph as G
from quire.operators import peaks as P
from quire.plans import config
from quire.scratch import clean, written
from quire.sinks.day_stats import DayStatsStore
from quire.sinks.gexf import write_gexf
from quire.sinks.tables import write_parquet
from quire.sinks.visits import VisitStore, load_period, open_store
from quire.sources.graphdb import GraphDatabase


def find(store: VisitStore, pages: DataFrame | None, links: DataFrame | None, start: date, end: date, language: str, cfg: dict, category_links: DataFrame | None = None, active_path: str | None = None, days: DayStatsStore | None = None, database: GraphDatabase | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, title), edges (src, dst, weight)) of the final graph.

    With a table of day statistics, thresholds and busy days come from it, and the
    history's visits are read only where z-scores need them. Without pages and
    links, those of the active pages are asked of a graph database.
    """
    if start > end:
        raise ValueError("start date is after end date")
    history = history_start(start, end)
    visits = load_period(store, history, end, language)
    stats = days.read(history, end, language) if days else None
    if cfg["peaks.activityZScore"]:
        z = [cfg[f"peaks.zscore.{k}"] for k in ("lag", "threshold", "influence", "activityThreshold")]
        active = P.zscore_pages(visits, history, start, end, *z)
    else:
        rule = history, start, end, cfg["peaks.burstRate"], cfg["peaks.burstCount"]
        active = Y.burst_pages(visits, stats, *rule) if days else P.burst_pages(visits, *rule)
    # Series, vertices and edges all start from the active pages, which are found once.
    if active_path and cfg["peaks.activityZScore"]:
        write_parquet(active, active_path)
        active = active.sparkSession.read.parquet(active_path)
    else:
        active = written(active, "active")
    series = P.active_series(visits, active, start, end, cfg["peaks.dailyMinThreshold"], stats)
    if database:
        # Asked once; later passes read what was said.
        pages, links = (written(x, "asked") for x in database.subgraph(active))
    nodes, edges = G.active_subgraph(pages, links, active, category_links, cfg["peaks.includeCategories"])
    # The vertices are read by the weights, by the components and by the graph that is written.
    nodes = written(nodes, "nodes")
    return P.peak_graph(nodes, edges, series, period_hours(start, end), cfg["peaks.minEdgeWeight"], cfg["peaks.pearsonCorrelation"])


def graph_name(start: date, end: date) -> str:
    return f"peaks_graph_{start:%Y%m%d}_{end:%Y%m%d}.gexf"


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--language", required=True)
    p.add_argument("--pages", help="Parquet: id, namespace, title; without it and links the graph database of the settings is asked")
    p.add_argument("--links", help="Parquet: from, dest")
    p.add_argument("--categoryLinks", help="Parquet: from, id")
    p.add_argument("--visits", help="Parquet store; without it visits come from Cassandra")
    p.add_argument("--outputPath", required=True)
    a = p.parse_args(args)
    cfg = config.load(a.config)
    spark = session.build("peak-graph", **config.connection(cfg))
    run(spark, a, cfg)
    clean(spark)


def run(spark: SparkSession, a: argparse.Namespace, cfg: dict) -> None:
    start, end = (date.fromisoformat(cfg[f"peaks.{k}"]) for k in ("startDate", "endDate"))
    store = open_store(spark, a.visits, cfg["store.keyspace"], cfg["store.tableVisits"], cfg["store.tableMeta"])
    more = spark.read.parquet(a.categoryLinks) if a.categoryLinks else None
    if cfg.get("peaks.useTableStats") and not cfg.get("store.tableStats"):
        raise ValueError("peaks.useTableStats needs store.tableStats, the folder of the day statistics")
    days = DayStatsStore(spark, cfg["store.tableStats"]) if cfg.get("peaks.useTableStats") else None
    active_path = f"{a.outputPath}/activePages.pqt" if cfg["peaks.zscore.saveOutput"] else None
    database = None if a.pages and a.links else GraphDatabase.of_settings(cfg)
    if database is None and not (a.pages and a.links):
        raise ValueError("pages and links are needed, or the setting graph.url")
    pages, links = (None, None) if database else (spark.read.parquet(a.pages), spark.read.parquet(a.links))
    vertices, edges = find(store, pages, links, start, end, a.language, cfg, more, active_path, days, database)
    write_gexf(vertices, edges, f"{a.outputPath}/{graph_name(start, end)}")


if __name__ == "__main__":
    main()
