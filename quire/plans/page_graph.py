"""Raw dumps of one language to a page graph as tab-separated tables for a bulk import."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.operators.closure import redirect_closure
from quire.operators.links import pages_by_namespace, resolve_category_links, resolve_links, resolve_redirects, substitute_closure, substitute_redirects
from quire.schemas import CATEGORY_NS, PAGE_NS
from quire.scratch import clean, written
from quire.sinks.files import write_text_file
from quire.sinks.tables import import_command, write_import_headers, write_tsv
from quire.sources.dumps import read_dump


def build(pages: DataFrame, links: DataFrame, redirects: DataFrame, category_links: DataFrame, to_the_end: bool = False, scratch: str | None = None) -> dict[str, DataFrame]:
    """The tables of the graph: pages without redirects, links past redirects, category links.

    A redirect is followed for one hop, or to the end of its chain; then there is
    a table more, of the redirects that run into cycles.
    """
    normal = pages_by_namespace(pages, PAGE_NS, keep_redirects=False)
    category = pages_by_namespace(pages, CATEGORY_NS, keep_redirects=False)
    resolved, hops, kept = resolve_links(pages, links), resolve_redirects(pages, redirects), normal.unionByName(category)
    more = {}
    if to_the_end:
        closure = redirect_closure(hops, scratch)
        direct = substitute_closure(resolved, closure, kept, drop_dangling=True)
        more = {"redirect_cycles": closure.where(F.col("cycle").isNotNull()).select("from", "cycle", "in_cycle")}
    else:
        direct = substitute_redirects(resolved, hops, kept)
    return {"page/normal_pages": normal, "page/category_pages": category, "pagelinks": direct, "categorylinks": resolve_category_links(pages, category, category_links), **more}


def run(spark: SparkSession, page: str, pagelinks: str, redirect: str, categorylinks: str, out: str, scratch: str | None = None, to_the_end: bool = False) -> None:
    """Each dump is parsed once, into scratch Parquet that all outputs read."""
    paths = {"page": page, "pagelinks": pagelinks, "redirect": redirect, "categorylinks": categorylinks}
    tables = {}
    for name, path in paths.items():
        tables[name] = written(read_dump(spark, path, name), name, scratch)
    graph = build(tables["page"], tables["pagelinks"], tables["redirect"], tables["categorylinks"], to_the_end, scratch)
    for name, rows in graph.items():
        write_tsv(rows, f"{out}/{name}")
    write_import_headers(tables["page"], f"{out}/headers")
    write_text_file(spark, f"{out}/import.sh", import_command(out, f"{out}/headers", "pages.db") + "\n")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dumpPath", required=True)
    p.add_argument("--outputPath", required=True)
    p.add_argument("--namePrefix", required=True, help="start of the files' names, such as xx-20180801")
    p.add_argument("--extension", default=".sql.bz2")
    p.add_argument("--followRedirects", action="store_true", help="to the end of their chains, not one hop; links to cycles go")
    a = p.parse_args(args)
    files = [f"{a.dumpPath}/{a.namePrefix}-{t}{a.extension}" for t in ("page", "pagelinks", "redirect", "categorylinks")]
    spark = session.build("page-graph")
    run(spark, *files, a.outputPath, to_the_end=a.followRedirects)
    clean(spark)


if __name__ == "__main__":
    main()
