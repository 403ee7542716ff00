"""The query catalogue: every operator on the test tables, with the same question in SQL.

The tables stand in for encyclopedia data: parts are pages (every fifth size a
category, every seventh a redirect to the page after it), line items are links
from a part's page to the page numbered like the supplier, events are visits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas as S
from quire.functions import series as X
from quire.functions.dates import covered, earliest, elapsed_hours, latest, period_hours
from quire.functions.hours import hour_visits, visits_of_day
from quire.operators import closure as C
from quire.operators import days as Y
from quire.operators import graph as G
from quire.operators import growing as N
from quire.operators import links as L
from quire.operators import peaks as P
from quire.operators import views as W
from quire.operators import visits as V
from quire.scratch import written
from quire.sources import dumps as D
from quire.sources.views import parse_views

Query = Callable[[SparkSession, str], DataFrame]
START, END = date(2024, 1, 1), date(2024, 1, 30)
MIDDLE = date(2024, 1, 11)
HOURS = period_hours(START, END)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------------------------------------------


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("int").alias("id"), F.when(F.col("p_size") % 5 == 0, 14).otherwise(0).alias("namespace"),
        F.concat_ws("_", "p_name", "p_partkey").alias("title"), (F.col("p_partkey") % 7 == 0).alias("isRedirect"), (F.col("p_size") > 25).alias("isNew"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    target = pages(spark, sf).select(F.col("id").alias("l_suppkey"), "title", "namespace")
    rows = _read(spark, sf, "lineitem").select(F.col("l_partkey").cast("int").alias("from"), F.col("l_suppkey").cast("int").alias("l_suppkey"), F.lit(0).alias("fromNamespace"))
    return rows.join(G.dealt(target), "l_suppkey").select("from", "namespace", "title", "fromNamespace")


def redirects(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    target = p.select((F.col("id") - 1).alias("from"), F.col("namespace").alias("targetNamespace"), "title")
    return p.where("isRedirect").select(F.col("id").alias("from")).join(G.dealt(target), "from")


def category_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each page belongs to the category numbered like a tenth of it."""
    p = pages(spark, sf)
    target = p.select(F.col("id").alias("c"), F.col("title").alias("to"))
    return p.select(F.col("id").alias("from"), F.floor(F.col("id") / 10).cast("int").alias("c"), F.lit("page").alias("ctype")).join(target, "c").select("from", "to", "ctype")


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """All event types as one language."""
    e = _read(spark, sf, "events").groupBy(F.col("user_id").alias("page_id"), F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("visit_time"))
    return e.agg(F.count("*").cast("int").alias("count")).select(F.lit("en").alias("languageCode"), "page_id", "visit_time", "count")


def visits_by_type(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").groupBy(F.col("event_type").alias("languageCode"), F.col("user_id").alias("page_id"), F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("visit_time"))
    return e.agg(F.count("*").cast("int").alias("count"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return rows.agg(F.sum(F.col("l_quantity").cast("double")).alias("weight"))


def forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vertices: all parts; edges: from a part of size up to 35 to half its number."""
    p = _read(spark, sf, "part")
    tree = p.where("p_size <= 35 AND p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"), F.lit(1.0).alias("weight"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), tree


_PAGES = """pages AS (SELECT CAST(p_partkey AS INTEGER) AS id, CASE WHEN p_size % 5 = 0 THEN 14 ELSE 0 END AS namespace,
    p_name || '_' || p_partkey AS title, p_partkey % 7 = 0 AS isRedirect, p_size > 25 AS isNew FROM part)"""
_LINKS = """links AS (SELECT CAST(l_partkey AS INTEGER) AS "from", p.namespace, p.title, 0 AS fromNamespace
    FROM lineitem JOIN pages p ON p.id = l_suppkey)"""
_REDIRECTS = """redirects AS (SELECT s.id AS "from", t.namespace AS targetNamespace, t.title FROM pages s JOIN pages t ON t.id = s.id + 1 WHERE s.isRedirect)"""
_RESOLVED = """resolved AS (SELECT l."from", p.id, l.title, l.fromNamespace, l.namespace FROM links l JOIN pages p USING (title, namespace))"""
_HOPS = """hops AS (SELECT r."from", p.id, r.title FROM redirects r JOIN pages p ON p.title = r.title AND p.namespace = r.targetNamespace
    WHERE EXISTS (SELECT 1 FROM pages s WHERE s.id = r."from"))"""
_CATLINKS = """catlinks AS (SELECT p.id AS "from", c.title AS "to", 'page' AS ctype FROM pages p JOIN pages c ON c.id = p.id // 10)"""
_VISITS = """visits AS (SELECT user_id AS page_id, date_trunc('hour', ts) AS visit_time, CAST(count(*) AS INTEGER) AS "count" FROM events GROUP BY 1, 2)"""
_GRID = f"""grid AS (SELECT u.page_id, h.hour, coalesce(v."count", 0) AS c FROM (SELECT DISTINCT page_id FROM visits) u,
    (SELECT unnest(range({HOURS})) AS hour) h LEFT JOIN visits v ON v.page_id = u.page_id AND v.visit_time = TIMESTAMP '2024-01-01' + to_hours(h.hour))"""
_EDGES = """edges AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(CAST(l_quantity AS DOUBLE)) AS weight FROM lineitem GROUP BY 1, 2)"""
_STATS = f"""stats AS (SELECT page_id, avg(c) AS mean, var_samp(c) AS variance FROM grid GROUP BY page_id)"""


# ---- dumps -----------------------------------------------------------------------------------------------------


def _dump(rows: DataFrame, table: str, *cells: str) -> DataFrame:
    """INSERT lines with some twenty tuples each, built from rows."""
    tuples = rows.select(F.concat(F.lit("("), F.concat_ws(",", *[F.expr(c) for c in cells]), F.lit(")")).alias("t"), F.expr(f"cast(k div 20 as bigint)").alias("g"))
    return tuples.groupBy("g").agg(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.array_join(F.collect_list("t"), ","), F.lit(";")).alias("value")).select("value")


@query("dump_page_parse", f"""WITH {_PAGES} SELECT id, namespace, title, isRedirect, isNew, CAST(0.25 AS DOUBLE) AS random,
    TIMESTAMP '2018-07-09 17:17:12' AS touched, id * 2 AS latest, id + 5 AS len FROM pages""")
def dump_page_parse(spark, sf):
    rows = pages(spark, sf).withColumn("k", F.col("id"))
    lines = _dump(rows, "page", "id", "namespace", "concat('\\'', title, '\\'')", "'\\'\\''", "cast(isRedirect as int)", "cast(isNew as int)", "'0.25'", "'\\'20180709171712\\''", "'NULL'", "id * 2", "id + 5", "'\\'wikitext\\''", "'NULL'")
    return D.parse_lines(lines, "page").select("id", "namespace", "title", "isRedirect", "isNew", "random", "touched", "latest", "len")


@query("dump_category_parse", """SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS title, p_size AS pages, p_size % 3 AS subcats, p_size % 4 AS files FROM part""")
def dump_category_parse(spark, sf):
    rows = _read(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    return D.parse_lines(_dump(rows, "category", "p_partkey", "concat('\\'', p_name, '\\'')", "p_size", "p_size % 3", "p_size % 4"), "category")


@query("dump_pagelinks_parse", f"""WITH {_PAGES}, {_LINKS} SELECT "from", namespace, title, fromNamespace, count(*) AS n FROM links GROUP BY ALL""")
def dump_pagelinks_parse(spark, sf):
    rows = links(spark, sf).withColumn("k", F.col("from"))
    found = D.parse_lines(_dump(rows, "pagelinks", "`from`", "namespace", "concat('\\'', title, '\\'')", "fromNamespace"), "pagelinks")
    return found.groupBy("from", "namespace", "title", "fromNamespace").agg(F.count("*").alias("n"))


@query("dump_redirect_parse", f"""WITH {_PAGES}, {_REDIRECTS} SELECT "from", targetNamespace, title, '''''' AS interwiki, 'NULL' AS fragment FROM redirects""")
def dump_redirect_parse(spark, sf):
    rows = redirects(spark, sf).withColumn("k", F.col("from"))
    return D.parse_lines(_dump(rows, "redirect", "`from`", "targetNamespace", "concat('\\'', title, '\\'')", "'\\'\\''", "'NULL'"), "redirect")


@query("dump_catlinks_parse", f"""WITH {_PAGES}, {_CATLINKS} SELECT "from", "to", upper("to") AS sortKey, TIMESTAMP '2014-10-26 04:50:23' AS timestamp,
    '' AS sortkeyPrefix, 'uca-default' AS collation, ctype FROM catlinks""")
def dump_catlinks_parse(spark, sf):
    rows = category_links(spark, sf).withColumn("k", F.col("from"))
    q = "concat('\\'', {}, '\\'')"
    return D.parse_lines(_dump(rows, "categorylinks", "`from`", q.format("`to`"), q.format("upper(`to`)"), "'\\'2014-10-26 04:50:23\\''", "'\\'\\''", "'\\'uca-default\\''", q.format("ctype")), "categorylinks")


@query("langlinks_filter", """SELECT CAST(c_custkey AS INTEGER) AS "from", CASE WHEN c_nationkey % 2 = 0 THEN 'fr' ELSE 'es' END AS lang,
    replace(c_mktsegment || ' ' || c_name, ' ', '_') AS title FROM customer WHERE c_nationkey % 2 = 0""")
def langlinks_filter(spark, sf):
    rows = _read(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    lines = _dump(rows, "langlinks", "c_custkey", "if(c_nationkey % 2 = 0, '\\'fr\\'', '\\'es\\'')", "concat('\\'', c_mktsegment, ' ', c_name, '\\'')")
    return D.parse_lines(lines, "langlinks", element_filter=D.language_filter(["fr"]))


@query("file_name_info", """SELECT n_nationkey AS k, lower(substr(n_name, 1, 2)) AS langCode, '2018080' || (n_nationkey % 10) AS dateCode,
    CASE WHEN n_nationkey % 2 = 0 THEN 'page' ELSE 'langlinks' END AS dumpType FROM nation""")
def file_name_info(spark, sf):
    n = _read(spark, sf, "nation")
    name = F.expr("concat(lower(substring(n_name, 1, 2)), 'wiki-2018080', n_nationkey % 10, '-', if(n_nationkey % 2 = 0, 'page', 'langlinks'), '.sql.bz2')")
    return n.select(F.col("n_nationkey").alias("k"), *D.dump_info_columns(name))


def _in_files(lines: DataFrame, name: str, codec: str, parts: int) -> str:
    """Write lines (value) as packed text in a folder of its own, each part named as a source would name it; the folder."""
    from quire.scratch import scratch_dir
    from quire.sinks.files import list_names, rename

    spark = lines.sparkSession
    folder = f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"
    lines.repartition(parts, F.xxhash64("value")).write.option("compression", codec).text(folder)
    for n, part in enumerate(x for x in list_names(spark, folder) if x.startswith("part-")):
        rename(spark, f"{folder}/{part}", f"{folder}/{name.format(n)}")
    return folder


@query("dump_gz_parse", """SELECT 'fr' AS languageCode, CAST(p_partkey AS INTEGER) AS id, p_name AS title, p_size AS pages, p_size % 3 AS subcats, p_size % 4 AS files FROM part
    UNION ALL SELECT 'es', CAST(p_partkey AS INTEGER), p_name, p_size, p_size % 3, p_size % 4 FROM part""")
def dump_gz_parse(spark, sf):
    """Gzipped dumps of two languages, several files each, unpacked by a task a file and dealt out for parsing."""
    rows = _read(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    lines = _dump(rows, "category", "p_partkey", "concat('\\'', p_name, '\\'')", "p_size", "p_size % 3", "p_size % 4")
    folders = [_in_files(lines, f"{x}wiki-20180801-category{{}}.sql.gz", "gzip", 2) for x in ("fr", "es")]
    return D.read_dump(spark, folders, "category", with_language=True, deal_bytes=2000)


@query("pages_from_dump", f"""WITH {_PAGES} SELECT 'en' AS languageCode, id, namespace, title, isRedirect, isNew FROM pages""")
def pages_from_dump(spark, sf):
    """The page table as a job takes it, from dump files."""
    rows = pages(spark, sf).withColumn("k", F.col("id"))
    lines = _dump(rows, "page", "id", "namespace", "concat('\\'', title, '\\'')", "'\\'\\''", "cast(isRedirect as int)", "cast(isNew as int)", "'0.25'", "'\\'20180709171712\\''", "'NULL'", "id * 2", "id + 5", "'\\'wikitext\\''", "'NULL'")
    folder = _in_files(lines, "enwiki-20180801-page{}.sql.gz", "gzip", 3)
    return D.read_pages(spark, f"{folder}/enwiki-20180801-page*.sql.gz").select("languageCode", "id", "namespace", "title", "isRedirect", "isNew")


# ---- pages and links -------------------------------------------------------------------------------------------


@query("pages_by_namespace", f"WITH {_PAGES} SELECT id, title, isRedirect, isNew FROM pages WHERE namespace = 0 AND NOT isRedirect")
def pages_by_namespace(spark, sf):
    return L.pages_by_namespace(pages(spark, sf), S.PAGE_NS, keep_redirects=False)


@query("pages_split", f"WITH {_PAGES} SELECT namespace = 14 AS category, id, title, isRedirect, isNew FROM pages")
def pages_split(spark, sf):
    normal, category = L.split_pages(pages(spark, sf))
    return normal.withColumn("category", F.lit(False)).unionByName(category.withColumn("category", F.lit(True)))


@query("link_resolve", f"WITH {_PAGES}, {_LINKS}, {_RESOLVED} SELECT * FROM resolved")
def link_resolve(spark, sf):
    return L.resolve_links(pages(spark, sf), links(spark, sf))


@query("redirect_resolve", f"WITH {_PAGES}, {_REDIRECTS}, {_HOPS} SELECT * FROM hops")
def redirect_resolve(spark, sf):
    return L.resolve_redirects(pages(spark, sf), redirects(spark, sf))


@query("catlink_resolve", f"""WITH {_PAGES}, {_CATLINKS} SELECT c."from", c."to" AS title, p.id, c.ctype FROM catlinks c JOIN pages p ON p.title = c."to"
    WHERE p.namespace = 14 AND NOT p.isRedirect AND EXISTS (SELECT 1 FROM pages s WHERE s.id = c."from")""")
def catlink_resolve(spark, sf):
    p = pages(spark, sf)
    return L.resolve_category_links(p, L.pages_by_namespace(p, S.CATEGORY_NS, keep_redirects=False), category_links(spark, sf))


_SUBSTITUTE = f"""direct AS (SELECT DISTINCT r."from", coalesce(h.id, r.id) AS dest FROM resolved r LEFT JOIN hops h ON h."from" = r.id
    WHERE r."from" <> coalesce(h.id, r.id) AND EXISTS (SELECT 1 FROM pages p WHERE p.id = r."from" AND NOT p.isRedirect))"""


def _direct(spark, sf):
    p = pages(spark, sf)
    return L.substitute_redirects(L.resolve_links(p, links(spark, sf)), L.resolve_redirects(p, redirects(spark, sf)), p)


@query("redirect_substitute", f"WITH {_PAGES}, {_LINKS}, {_REDIRECTS}, {_RESOLVED}, {_HOPS}, {_SUBSTITUTE} SELECT * FROM direct")
def redirect_substitute(spark, sf):
    return _direct(spark, sf)


@query("category_ancestry", f"""WITH {_PAGES}, {_CATLINKS}, steps AS (SELECT c."from", p.id AS "to" FROM catlinks c JOIN pages p ON p.title = c."to" WHERE p.namespace = 14),
    wanted AS (SELECT id FROM pages WHERE namespace = 14),
    one AS (SELECT "from" FROM steps WHERE "to" IN (SELECT id FROM wanted)),
    two AS (SELECT "from" FROM steps WHERE "to" IN (SELECT "from" FROM one))
    SELECT DISTINCT id, title FROM pages WHERE id IN (SELECT "from" FROM one UNION SELECT "from" FROM two)""")
def category_ancestry(spark, sf):
    p = pages(spark, sf)
    found = L.resolve_category_links(p, p.where(F.col("namespace") == S.CATEGORY_NS), category_links(spark, sf))
    return L.category_ancestry(found.select("from", "id"), p, F.when(F.col("namespace") == S.CATEGORY_NS, F.col("title")))


def _page_table(spark, sf) -> DataFrame:
    from quire.scratch import scratch_dir
    from quire.sinks.pages import write_page_table

    name = f"pages_{uuid.uuid4().hex}"
    return write_page_table(pages(spark, sf), f"{scratch_dir(spark)}/{name}", name, 8)


@query("link_resolve_by_title", f"WITH {_PAGES}, {_LINKS}, {_RESOLVED} SELECT * FROM resolved")
def link_resolve_by_title(spark, sf):
    """link_resolve over a page table in buckets of titles; hot titles are joined apart."""
    from quire.sinks.pages import resolve_links_by_title

    return resolve_links_by_title(_page_table(spark, sf), written(links(spark, sf), "links"))


@query("redirect_resolve_by_title", f"WITH {_PAGES}, {_REDIRECTS}, {_HOPS} SELECT * FROM hops")
def redirect_resolve_by_title(spark, sf):
    from quire.sinks.pages import resolve_redirects_by_title

    return resolve_redirects_by_title(_page_table(spark, sf), written(redirects(spark, sf), "redirects"))


@query("catlink_resolve_by_title", f"""WITH {_PAGES}, {_CATLINKS} SELECT c."from", c."to" AS title, p.id, c.ctype FROM catlinks c JOIN pages p ON p.title = c."to"
    WHERE p.namespace = 14 AND NOT p.isRedirect AND EXISTS (SELECT 1 FROM pages s WHERE s.id = c."from")""")
def catlink_resolve_by_title(spark, sf):
    from quire.sinks.pages import resolve_category_links_by_title

    return resolve_category_links_by_title(_page_table(spark, sf), written(category_links(spark, sf), "categorylinks"))


_CHAINS = """chains AS (SELECT p.p_partkey AS "from", t.p_partkey AS id FROM part p
    JOIN part t ON t.p_partkey = CASE WHEN p.p_partkey % 32 = 0 THEN p.p_partkey - 23 ELSE p.p_partkey + 1 END WHERE p.p_size % 20 <> 0)"""


def _chains(spark, sf) -> DataFrame:
    """Redirects in runs of up to 32 pages; the last of a run leads back to its ninth, so that whole runs are cycles with a tail."""
    p = _read(spark, sf, "part")
    to = F.when(F.col("p_partkey") % 32 == 0, F.col("p_partkey") - 23).otherwise(F.col("p_partkey") + 1)
    rows = p.where("p_size % 20 <> 0").select(F.col("p_partkey").alias("from"), to.alias("id"))
    return rows.join(p.select(F.col("p_partkey").alias("id")), "id", "left_semi")


@query("redirect_closure", f"""WITH RECURSIVE {_CHAINS},
    walk(origin, spot, hops) AS (SELECT "from", id, CAST(1 AS BIGINT) FROM chains UNION ALL SELECT origin, id, hops + 1 FROM walk JOIN chains ON "from" = spot WHERE hops < 64),
    ends AS (SELECT origin, spot, hops FROM walk WHERE spot NOT IN (SELECT "from" FROM chains)),
    rings AS (SELECT origin, min(spot) FILTER (hops > 32) AS cycle, bool_or(spot = origin) AS in_cycle FROM walk GROUP BY origin)
    SELECT origin AS "from", spot AS id, hops, CASE WHEN spot IS NULL THEN cycle END AS cycle, spot IS NULL AND in_cycle AS in_cycle FROM rings LEFT JOIN ends USING (origin)""")
def redirect_closure(spark, sf):
    return C.redirect_closure(_chains(spark, sf))


@query("redirect_substitute_closure", f"""WITH RECURSIVE {_CHAINS},
    walk(origin, spot, hops) AS (SELECT "from", id, 1 FROM chains UNION ALL SELECT origin, id, hops + 1 FROM walk JOIN chains ON "from" = spot WHERE hops < 64),
    ends AS (SELECT origin, spot FROM walk WHERE spot NOT IN (SELECT "from" FROM chains)),
    plain AS (SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT "from" FROM chains))
    SELECT DISTINCT l_partkey AS "from", coalesce(spot, l_suppkey) AS dest FROM lineitem LEFT JOIN ends ON origin = l_suppkey
    WHERE l_partkey <> coalesce(spot, l_suppkey) AND l_partkey IN (SELECT id FROM plain) AND coalesce(spot, l_suppkey) IN (SELECT id FROM plain)""")
def redirect_substitute_closure(spark, sf):
    """Links with chains of redirects followed to the end; links to cycles go."""
    chains = _chains(spark, sf)
    redirecting = chains.select(F.col("from").alias("id"), F.lit(True).alias("isRedirect"))
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id")).join(redirecting, "id", "left").select("id", F.coalesce("isRedirect", F.lit(False)).alias("isRedirect"))
    rows = _read(spark, sf, "lineitem").select(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("id"))
    return L.substitute_closure(rows, C.redirect_closure(chains), p, drop_dangling=True)


@query("category_closure", """WITH RECURSIVE steps AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 10 THEN p_partkey * 7 % 10 ELSE p_partkey // 10 END AS up FROM part),
    walk(id, ancestor, depth) AS (SELECT id, up, 1 FROM steps UNION ALL SELECT walk.id, up, depth + 1 FROM walk JOIN steps ON steps.id = ancestor WHERE depth < 16)
    SELECT id, ancestor, min(depth) AS depth FROM walk GROUP BY ALL""")
def category_closure(spark, sf):
    """Every category above each page; the topmost ones lie on cycles, one of them its own."""
    p = F.col("p_partkey")
    return C.ancestry(_read(spark, sf, "part").select(p.alias("from"), F.when(p < 10, p * 7 % 10).otherwise(F.floor(p / 10)).alias("id")))


# ---- page views ------------------------------------------------------------------------------------------------


def _daily(spark, sf) -> DataFrame:
    """Events as page-view lines: one per user, day and event type as access method."""
    e = _read(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.hour(F.col("ts").cast("timestamp")).alias("h"))
    hours = e.groupBy("user_id", "event_type", "day", "h").agg(F.count("*").alias("n"))
    rows = hours.groupBy("user_id", "event_type", "day").agg(F.sum("n").alias("daily"), F.array_sort(F.collect_list(F.struct("h", "n"))).alias("hs"))
    return rows.select("user_id", "event_type", "day", "daily", F.array_join(F.transform("hs", lambda x: F.concat(F.char(x["h"] + 65), x["n"].cast("string"))), "").alias("code"))


_DAILY = """hourly AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL),
    daily AS (SELECT user_id, event_type, day, sum(n) AS daily, string_agg(chr(CAST(65 + h AS INTEGER)) || n, '' ORDER BY h) AS code FROM hourly GROUP BY ALL)"""


def _lines(spark, sf, legacy=False) -> DataFrame:
    rows = _daily(spark, sf)
    page = F.concat(F.when(F.col("user_id") % 4 == 0, "Category:").otherwise(""), F.lit("User_"), F.col("user_id"))
    head = "en.z" if legacy else "en.wikipedia"
    middle = [] if legacy else [F.lit("null"), F.col("event_type")]
    line = F.concat_ws(" ", F.lit(head), page, *middle, "daily", "code")
    comment = F.when((F.col("user_id") % 9 == 0) & (F.col("event_type") == "view"), F.concat(F.lit("# "), line)).otherwise(line)
    return rows.select(comment.alias("value"), F.col("day").cast("string").alias("day"))


_TITLE = "CASE WHEN user_id % 4 = 0 THEN 'Category:' ELSE '' END || 'User_' || user_id"
_LIVE = "NOT (user_id % 9 = 0 AND event_type = 'view')"


@query("pageview_parse", f"""WITH {_DAILY} SELECT 'en' AS languageCode, {_TITLE} AS title, CASE WHEN user_id % 4 = 0 THEN 14 ELSE 0 END AS namespace,
    event_type AS source, CAST(daily AS INTEGER) AS dailyVisits, code AS hourlyVisits, strftime(day, '%Y-%m-%d') AS day FROM daily WHERE {_LIVE}""")
def pageview_parse(spark, sf):
    return parse_views(_lines(spark, sf), languages=["en"])


@query("legacy_parse", f"""WITH {_DAILY} SELECT 'en' AS languageCode, 'User_' || user_id AS title, CASE WHEN user_id % 4 = 0 THEN 14 ELSE 0 END AS namespace,
    'web' AS source, CAST(daily AS INTEGER) AS dailyVisits, code AS hourlyVisits, strftime(day, '%Y-%m-%d') AS day FROM daily WHERE {_LIVE}""")
def legacy_parse(spark, sf):
    return parse_views(_lines(spark, sf, legacy=True), legacy=True)


@query("views_files", f"""WITH {_DAILY} SELECT 'en' AS languageCode, {_TITLE} AS title, CASE WHEN user_id % 4 = 0 THEN 14 ELSE 0 END AS namespace,
    event_type AS source, CAST(daily AS INTEGER) AS dailyVisits, code AS hourlyVisits, day AS date FROM daily WHERE {_LIVE}""")
def views_files(spark, sf):
    """Page views from a packed file for each day, as they are published; the date comes from the file's name."""
    from quire.scratch import scratch_dir
    from quire.sinks.files import list_names, rename
    from quire.sources.views import read_views

    base = f"{scratch_dir(spark)}/views-{uuid.uuid4().hex}"
    _lines(spark, sf).repartition("day").write.partitionBy("day").option("compression", "bzip2").text(base)
    days = [date.fromisoformat(x.removeprefix("day=")) for x in list_names(spark, base) if x.startswith("day=")]
    for d in days:
        (part,) = [x for x in list_names(spark, f"{base}/day={d}") if x.startswith("part-")]
        rename(spark, f"{base}/day={d}/{part}", f"{base}/pageviews-{d:%Y%m%d}-user.bz2")
    return read_views(spark, base, days)


def _world(spark, sf) -> DataFrame:
    """The lines in four languages, with escapes in their titles."""
    rows = _daily(spark, sf)
    code = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("user_id") % 4 + 1).cast("int"))
    line = F.concat_ws(" ", F.concat(code, F.lit(".wikipedia")), F.concat(F.lit("Caf%C3%A9_%28"), "user_id", F.lit("%29")), F.lit("null"), "event_type", "daily", "code")
    return rows.select(line.alias("value"), F.col("day").cast("string").alias("day"))


@query("pageview_languages", f"""WITH {_DAILY} SELECT ['en', 'fr', 'de', 'es'][CAST(user_id % 4 + 1 AS INTEGER)] AS languageCode, 'Caf%C3%A9_%28' || user_id || '%29' AS title, 0 AS namespace,
    event_type AS source, CAST(daily AS INTEGER) AS dailyVisits, code AS hourlyVisits, strftime(day, '%Y-%m-%d') AS day FROM daily WHERE user_id % 4 IN (1, 3)""")
def pageview_languages(spark, sf):
    return parse_views(_world(spark, sf), languages=["es", "fr", "xx"])


@query("pageview_decode", f"""WITH {_DAILY} SELECT ['en', 'fr', 'de', 'es'][CAST(user_id % 4 + 1 AS INTEGER)] AS languageCode, 'Café_(' || user_id || ')' AS title, 0 AS namespace,
    event_type AS source, CAST(daily AS INTEGER) AS dailyVisits, code AS hourlyVisits, strftime(day, '%Y-%m-%d') AS day FROM daily""")
def pageview_decode(spark, sf):
    return parse_views(_world(spark, sf), decode_titles=True)


@query("pageview_merge", f"""WITH {_DAILY}, live AS (SELECT * FROM hourly WHERE {_LIVE}),
    sums AS (SELECT user_id, day, h, sum(n) AS n FROM live GROUP BY ALL)
    SELECT {_TITLE} AS title, 'en' AS languageCode, CASE WHEN user_id % 4 = 0 THEN 14 ELSE 0 END AS namespace, strftime(day, '%Y-%m-%d') AS day, 'web' AS source,
    CAST(sum(n) AS INTEGER) AS dailyVisits, string_agg(chr(CAST(65 + h AS INTEGER)) || n, '' ORDER BY h) AS hourlyVisits FROM sums GROUP BY user_id, day HAVING sum(n) > 2""")
def pageview_merge(spark, sf):
    return W.merge_views(parse_views(_lines(spark, sf)), 2, "day")


@query("hour_decode", f"""WITH {_DAILY}, x AS (SELECT user_id, event_type, day, unnest(regexp_extract_all(code, '[A-X][0-9]+')) AS e FROM daily)
    SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, ascii(e) - 65 AS hour, CAST(substr(e, 2) AS INTEGER) AS visits FROM x""")
def hour_decode(spark, sf):
    return _daily(spark, sf).select("user_id", "event_type", F.col("day").cast("string").alias("day"), F.inline(hour_visits(F.col("code"))))


@query("visit_granularity", f"""WITH {_DAILY}
    SELECT user_id, event_type, CAST(day AS TIMESTAMP) AS time, CAST(daily AS INTEGER) AS "count", 'Day' AS timeResolution FROM daily WHERE daily < 2
    UNION ALL SELECT d.user_id, d.event_type, CAST(d.day AS TIMESTAMP) + to_hours(h.h), CAST(h.n AS INTEGER), 'Hour'
    FROM daily d JOIN hourly h USING (user_id, event_type, day) WHERE d.daily >= 2""")
def visit_granularity(spark, sf):
    return _daily(spark, sf).select("user_id", "event_type", F.inline(visits_of_day(F.col("daily"), F.col("code"), F.col("day"), 2)))


@query("visit_rows", f"""WITH {_PAGES}, {_DAILY}, live AS (SELECT * FROM hourly WHERE {_LIVE}),
    days AS (SELECT user_id, day FROM live GROUP BY ALL HAVING sum(n) > 1),
    known AS (SELECT id, 'User_' || id AS title, CASE WHEN id % 4 = 0 THEN 14 ELSE 0 END AS namespace FROM pages WHERE NOT isRedirect)
    SELECT 'en' AS languageCode, CAST(k.id AS BIGINT) AS page_id, CAST(l.day AS TIMESTAMP) + to_hours(l.h) AS visit_time, CAST(sum(l.n) AS INTEGER) AS "count"
    FROM live l JOIN days USING (user_id, day) JOIN known k ON k.title = 'User_' || l.user_id GROUP BY ALL""")
def visit_rows(spark, sf):
    views = parse_views(_lines(spark, sf), strip_namespace=True)
    known = pages(spark, sf).select("id", F.concat(F.lit("User_"), "id").alias("title"), F.when(F.col("id") % 4 == 0, 14).otherwise(0).alias("namespace"), "isRedirect", F.lit("en").alias("languageCode"))
    return W.visit_rows(known, W.page_visits(views.withColumnRenamed("day", "d"), 1, 0, F.to_date("d")))


# ---- visits and series -----------------------------------------------------------------------------------------


@query("visits_period", """SELECT event_type AS languageCode, user_id AS page_id, date_trunc('hour', ts) AS visit_time, CAST(count(*) AS INTEGER) AS "count"
    FROM events WHERE ts >= DATE '2024-01-11' AND ts < DATE '2024-01-21' AND event_type = 'view' GROUP BY ALL""")
def visits_period(spark, sf):
    return V.in_period(visits_by_type(spark, sf), MIDDLE, date(2024, 1, 20), "view")


@query("series_group", f"""WITH {_VISITS} SELECT page_id, count(*) AS n, CAST(sum("count") AS BIGINT) AS total, min(visit_time) AS first_time, max(visit_time) AS last_time FROM visits GROUP BY 1""")
def series_group(spark, sf):
    v = V.series(visits(spark, sf))
    total = F.aggregate("visits", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return v.select("page_id", F.size("visits").cast("long").alias("n"), total.alias("total"), F.get("visits", F.lit(0))["visit_time"].alias("first_time"), F.element_at("visits", -1)["visit_time"].alias("last_time"))


@query("history_cut", f"""WITH {_VISITS} SELECT page_id, count(*) FILTER (visit_time >= DATE '2024-01-11') AS n FROM visits GROUP BY 1""")
def history_cut(spark, sf):
    return V.cut_history(V.series(visits(spark, sf)), MIDDLE).select("page_id", F.size("visits").cast("long").alias("n"))


@query("date_coverage", """WITH days AS (SELECT DISTINCT unnest(generate_series(CAST(d AS DATE), CAST(d AS DATE) + CAST(k % 3 AS INTEGER), INTERVAL 1 DAY)) AS day
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d, user_id % 5 AS k FROM events))
    SELECT count(*) FILTER (day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') = 21 AS covered FROM days""")
def date_coverage(spark, sf):
    meta = _read(spark, sf, "events").select(F.to_date("ts").alias("d"), (F.col("user_id") % 5).alias("k")).distinct()
    meta = meta.select(F.to_timestamp("d").alias("start_time"), F.to_timestamp(F.date_add("d", (F.col("k") % 3).cast("int"))).alias("end_time"))
    return covered(meta, date(2024, 1, 5), date(2024, 1, 25))


@query("date_merge", """SELECT o_orderkey, least(o_orderdate, CAST(DATE '1995-06-17' AS TIMESTAMP)) AS first_time,
    greatest(o_orderdate, CAST(DATE '1995-06-18' AS TIMESTAMP)) AS last_time FROM orders""")
def date_merge(spark, sf):
    o = _read(spark, sf, "orders")
    day, now = F.lit(date(1995, 6, 17)), F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", earliest(now, day).alias("first_time"), latest(now, day).alias("last_time"))


@query("elapsed_hours", """SELECT event_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS INTEGER) AS hour FROM events""")
def elapsed(spark, sf):
    return _read(spark, sf, "events").select("event_id", elapsed_hours(START, F.col("ts").cast("timestamp")).alias("hour"))


@query("dense_hours", f"WITH {_VISITS}, {_GRID} SELECT page_id, CAST(hour AS INTEGER) AS hour, CAST(c AS DOUBLE) AS value FROM grid")
def dense_hours(spark, sf):
    return V.dense(visits(spark, sf), START, END).select("page_id", F.posexplode("values").alias("hour", "value"))


@query("series_stats", f"WITH {_VISITS}, {_GRID}, {_STATS} SELECT page_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM stats")
def series_stats(spark, sf):
    return V.stats(visits(spark, sf), START, END).select("page_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_BURST = f"""limits AS (SELECT page_id, mean + 5 * sqrt(variance) AS threshold FROM stats),
    burst AS (SELECT page_id FROM visits JOIN limits USING (page_id) WHERE visit_time >= DATE '2024-01-11' AND "count" > threshold GROUP BY 1 HAVING count(*) > 1)"""


@query("burst_pages", f"WITH {_VISITS}, {_GRID}, {_STATS}, {_BURST} SELECT page_id FROM burst")
def burst_pages(spark, sf):
    return P.burst_pages(visits(spark, sf), START, MIDDLE, END, 5.0, 1)


@query("active_series", f"""WITH {_VISITS}, {_GRID}, {_STATS}, {_BURST}, days AS (SELECT page_id, CAST(visit_time AS DATE) AS d, sum("count") AS n FROM visits GROUP BY 1, 2),
    busy AS (SELECT page_id FROM days GROUP BY 1 HAVING max(n) >= 6)
    SELECT page_id, CAST(sum("count") AS DOUBLE) AS total FROM visits WHERE page_id IN (SELECT page_id FROM busy) AND page_id IN (SELECT page_id FROM burst) GROUP BY 1""")
def active_series(spark, sf):
    v = visits(spark, sf)
    found = P.active_series(v, P.burst_pages(v, START, MIDDLE, END, 5.0, 1), START, END, 6)
    return found.select("page_id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _day_table(spark, sf) -> DataFrame:
    """The day table, counted in two goes, the second of which begins with a day that was there."""
    from quire.scratch import scratch_dir
    from quire.sinks.day_stats import DayStatsStore

    store, v = DayStatsStore(spark, f"{scratch_dir(spark)}/days-{uuid.uuid4().hex}"), visits(spark, sf)
    store.append(v, START, MIDDLE)
    store.append(v, MIDDLE, END)
    return store.read(START, END)


@query("day_stats", f"""WITH {_VISITS} SELECT 'en' AS languageCode, page_id, CAST(visit_time AS DATE) AS day, count(*) AS entries, count(*) AS hours, CAST(sum("count") AS BIGINT) AS total,
    CAST(sum("count" * "count") AS DOUBLE) AS squares, max("count") AS most FROM visits GROUP BY page_id, day""")
def day_stats(spark, sf):
    return _day_table(spark, sf)


@query("day_series_stats", f"WITH {_VISITS}, {_GRID}, {_STATS} SELECT page_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM stats")
def day_series_stats(spark, sf):
    """series_stats from the day table, without a look at visits."""
    return Y.stats(_day_table(spark, sf), START, END).select("page_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("day_maximum", f"""WITH {_VISITS}, d AS (SELECT page_id, CAST(visit_time AS DATE) AS d, sum("count") AS n FROM visits WHERE visit_time >= DATE '2024-01-11' GROUP BY 1, 2)
    SELECT page_id, CAST(max(n) AS BIGINT) AS daily_max FROM d GROUP BY 1""")
def day_maximum(spark, sf):
    return Y.daily_maximum(_day_table(spark, sf), MIDDLE, END)


@query("day_burst_pages", f"WITH {_VISITS}, {_GRID}, {_STATS}, {_BURST} SELECT page_id FROM burst")
def day_burst_pages(spark, sf):
    """burst_pages with thresholds from the day table and visits of the days that pass them."""
    return Y.burst_pages(visits(spark, sf), _day_table(spark, sf), START, MIDDLE, END, 5.0, 1)


_PAIRS = """pairs AS (SELECT a.page_id AS a, a.page_id + 1 AS b FROM (SELECT DISTINCT page_id FROM visits) a WHERE a.page_id + 1 IN (SELECT page_id FROM visits))"""


def _pairs(spark, sf):
    d = V.dense(visits(spark, sf), START, END)
    return d.select(F.col("page_id").alias("a"), F.col("values").alias("va")).join(d.select((F.col("page_id") - 1).alias("a"), F.col("page_id").alias("b"), F.col("values").alias("vb")), "a")


@query("ratio_similarity", f"""WITH {_VISITS}, {_GRID}, {_PAIRS}, r AS (SELECT p.a, p.b, least(x.c, y.c) / nullif(greatest(x.c, y.c), 0) AS r
    FROM pairs p JOIN grid x ON x.page_id = p.a JOIN grid y ON y.page_id = p.b AND y.hour = x.hour)
    SELECT a, b, round(coalesce(sum(r) FILTER (r > 0.5), 0), 6) AS similarity FROM r GROUP BY a, b""")
def ratio_similarity(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(X.ratio_similarity(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query("pearson_pairs", f"""WITH {_VISITS}, {_GRID}, {_PAIRS}
    SELECT p.a, p.b, round(CASE WHEN isnan(corr(x.c, y.c)) THEN 0 ELSE coalesce(corr(x.c, y.c), 0) END, 6) + 0 AS r
    FROM pairs p JOIN grid x ON x.page_id = p.a JOIN grid y ON y.page_id = p.b AND y.hour = x.hour GROUP BY p.a, p.b""")
def pearson_pairs(spark, sf):
    return _pairs(spark, sf).select("a", "b", (F.round(X.pearson(F.col("va"), F.col("vb")), 6) + 0).alias("r"))


_NEAR = f"""near AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey),
    linked AS (SELECT src, dst FROM near WHERE src IN (SELECT page_id FROM visits) AND dst IN (SELECT page_id FROM visits)),
    met AS (SELECT src, dst, CAST(x."count" AS DOUBLE) AS a, CAST(y."count" AS DOUBLE) AS b FROM linked JOIN visits x ON x.page_id = src JOIN visits y ON y.page_id = dst AND y.visit_time = x.visit_time)"""


def _near(spark, sf):
    """(vertices, edges, series): linked pages that both have visits."""
    series = written(V.dense(visits(spark, sf), START, END), "series")
    vertices = series.select(F.col("page_id").alias("id"))
    # Links of pages without visits go before links are joined into pairs.
    inside = G.induced(vertices, edges(spark, sf).where("src <> dst"), vertices)[1]
    return vertices, G.undirected(inside, F.max), series


@query("similar_edges", f"""WITH {_VISITS}, {_NEAR}, sums AS (SELECT page_id, sum(CAST("count" AS DOUBLE)) AS s, sum(CAST("count" AS DOUBLE) * "count") AS q FROM visits GROUP BY 1),
    products AS (SELECT src, dst, sum(a * b) AS p FROM met GROUP BY 1, 2),
    weights AS (SELECT src, dst, {HOURS} * ({HOURS} * p - x.s * y.s) / sqrt(({HOURS} * x.q - x.s * x.s) * ({HOURS} * y.q - y.s * y.s)) AS weight
        FROM products JOIN sums x ON x.page_id = src JOIN sums y ON y.page_id = dst)
    SELECT src, dst, round(weight, 6) AS weight FROM weights WHERE weight > {HOURS // 20}""")
def similar_edges(spark, sf):
    """Linked pages whose hourly visits correlate; edges that sketches rule out never see the series."""
    vertices, pairs, series = _near(spark, sf)
    sketched = written(P.with_sketches(series.select("page_id", X.standard(F.col("values")).alias("shape"))), "sketched")
    return P.similar_edges(vertices, pairs, sketched, HOURS, HOURS / 20).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("similar_ratio_edges", f"""WITH {_VISITS}, {_NEAR}, ratios AS (SELECT src, dst, least(a, b) / greatest(a, b) AS r FROM met)
    SELECT src, dst, round(sum(r), 6) AS weight FROM ratios WHERE r > 0.5 GROUP BY 1, 2 HAVING sum(r) > 6""")
def similar_ratio_edges(spark, sf):
    """Linked pages with like visits in more than six hours."""
    vertices, pairs, series = _near(spark, sf)
    sketched = written(P.with_sketches(series.select("page_id", F.col("values").alias("shape")), correlation=False), "sketched")
    return P.similar_edges(vertices, pairs, sketched, HOURS, 6.0, correlation=False).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("top_page", f"""WITH {_VISITS} SELECT page_id, CAST(sum("count") AS BIGINT) AS total FROM visits GROUP BY 1 ORDER BY total DESC, page_id LIMIT 1""")
def top_page(spark, sf):
    return V.top_pages(visits(spark, sf))


@query("visits_union", """SELECT event_type AS languageCode, user_id AS page_id, date_trunc('hour', ts) AS visit_time, CAST(count(*) AS INTEGER) AS "count" FROM events GROUP BY ALL""")
def visits_union(spark, sf):
    """The table put together again from a slice for each language."""
    v = visits_by_type(spark, sf)
    whole = None
    for kind in ("click", "error", "purchase", "signup", "view"):
        part = v.where(F.col("languageCode") == kind)
        whole = part if whole is None else whole.unionByName(part)
    return whole


# ---- graphs ----------------------------------------------------------------------------------------------------


@query("undirected_sum", f"WITH {_EDGES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM edges GROUP BY 1, 2")
def undirected_sum(spark, sf):
    return G.undirected(edges(spark, sf))


@query("undirected_max", f"WITH {_EDGES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM edges GROUP BY 1, 2")
def undirected_max(spark, sf):
    return G.undirected(edges(spark, sf), F.max)


@query("prune_edges", f"WITH {_EDGES} SELECT src, dst, weight FROM edges WHERE weight > 40")
def prune_edges(spark, sf):
    return G.prune_edges(edges(spark, sf), 40)


@query("drop_singletons", """SELECT p_partkey AS id, p_name AS title FROM part p WHERE EXISTS (SELECT 1 FROM part q
    WHERE q.p_size <= 35 AND q.p_partkey > 1 AND (p.p_partkey = q.p_partkey OR p.p_partkey = q.p_partkey // 2))""")
def drop_singletons(spark, sf):
    vertices, tree = forest(spark, sf)
    return G.without_singletons(vertices, tree).select("id", "title")


@query("active_subgraph", f"""WITH {_PAGES}, {_LINKS}, {_REDIRECTS}, {_RESOLVED}, {_HOPS}, {_SUBSTITUTE}, {_VISITS}, {_GRID}, {_STATS}, {_BURST},
    act AS (SELECT id FROM pages WHERE id IN (SELECT page_id FROM burst) AND namespace <> 14)
    SELECT "from" AS src, dest AS dst, CAST(1 AS DOUBLE) AS weight FROM direct WHERE "from" IN (SELECT id FROM act) AND dest IN (SELECT id FROM act)""")
def active_subgraph(spark, sf):
    p = pages(spark, sf)
    return G.active_subgraph(p, _direct(spark, sf), P.burst_pages(visits(spark, sf), START, MIDDLE, END, 5.0, 1))[1]


@query("triplets", f"""WITH {_EDGES} SELECT src, dst, weight, a.p_name AS src_title, b.p_name AS dst_title FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst""")
def triplets(spark, sf):
    vertices, _ = forest(spark, sf)
    return G.triplets(vertices, edges(spark, sf), "title").select("src", "dst", "weight", "src_title", "dst_title")


@query("outer_series", f"""WITH {_VISITS}, s AS (SELECT page_id, CAST(sum("count") AS BIGINT) AS total FROM visits GROUP BY 1)
    SELECT p_partkey AS id, p_name AS title, coalesce(total, 0) AS total FROM part LEFT JOIN s ON page_id = p_partkey""")
def outer_series(spark, sf):
    vertices, _ = forest(spark, sf)
    return G.with_attributes(vertices, visits(spark, sf).groupBy("page_id").agg(F.sum(F.col("count").cast("long")).alias("total")), "page_id").select("id", "title", F.coalesce("total", F.lit(0).cast("long")).alias("total"))


_COMPONENTS = """WITH RECURSIVE parent AS (SELECT p_partkey AS id, CASE WHEN p_size <= 35 AND p_partkey > 1 THEN p_partkey // 2 END AS up FROM part),
    climb(id, top) AS (SELECT id, id FROM parent WHERE up IS NULL UNION ALL SELECT p.id, c.top FROM parent p JOIN climb c ON p.up = c.id)"""


@query("components", f"{_COMPONENTS} SELECT id, top AS component FROM climb")
def components(spark, sf):
    return G.connected_components(*forest(spark, sf))


def _grown(spark, sf):
    """Components of the forest, whose edges come in three batches by the size of their part, with the first half of the vertices."""
    vertices, tree = forest(spark, sf)
    sized = tree.join(G.dealt(_read(spark, sf, "part").select(F.col("p_partkey").alias("src"), "p_size")), "src")
    batch = [sized.where(c).select("src", "dst") for c in ("p_size <= 12", "p_size > 12 AND p_size <= 24", "p_size > 24")]
    known = N.begin(vertices.where("id % 2 = 0"), batch[0])
    for more in batch[1:]:
        known = N.extend(known, more)
    return N.extend(known, batch[0], vertices)


@query("components_grown", f"{_COMPONENTS} SELECT id, top AS component FROM climb")
def components_grown(spark, sf):
    """components, kept up to date while edges come."""
    return _grown(spark, sf).labels


@query("largest_component_grown", f"{_COMPONENTS} SELECT top AS component, count(*) AS size FROM climb GROUP BY top ORDER BY size DESC, component LIMIT 1")
def largest_component_grown(spark, sf):
    return _grown(spark, sf).largest()


@query("largest_component", f"""{_COMPONENTS}, best AS (SELECT top FROM climb GROUP BY top ORDER BY count(*) DESC, top LIMIT 1)
    SELECT p.id AS src, p.up AS dst, CAST(1 AS DOUBLE) AS weight FROM parent p JOIN climb c ON c.id = p.id JOIN best USING (top) WHERE p.up IS NOT NULL""")
def largest_component(spark, sf):
    return G.largest_component_graph(*forest(spark, sf))[1]


@query("gexf_elements", """SELECT 0 AS part, p_partkey AS a, CAST(0 AS BIGINT) AS b, '      <node id="' || p_partkey || '" label="' || replace(replace(replace(replace(p_name || ' & <' || p_brand || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" />' AS line FROM part
    UNION ALL SELECT 1, p_partkey, p_partkey // 2, '        <edge source="' || p_partkey || '" target="' || (p_partkey // 2) || '" label="1.0" weight="1.0" />' FROM part WHERE p_size <= 35 AND p_partkey > 1""")
def gexf(spark, sf):
    _, tree = forest(spark, sf)
    nodes = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), G.xml_escape(F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">"))).alias("title"))
    return G.gexf_elements(nodes, tree)


@query("gexf_file", """SELECT '      <node id="' || p_partkey || '" label="' || replace(p_name, '&', '&amp;') || '" />' AS value FROM part
    UNION ALL SELECT '        <edge source="' || p_partkey || '" target="' || (p_partkey // 2) || '" label="1.0" />' FROM part WHERE p_size <= 35 AND p_partkey > 1
    UNION ALL SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', ' <graph mode="static" defaultedgetype="directed">',
        ' <nodes>', '      </nodes>', '      <edges>', '        </edges>', ' </graph>', '</gexf>'])""")
def gexf_file(spark, sf):
    """The lines of an unweighted document, written as one file and read back."""
    from quire.scratch import scratch_dir
    from quire.sinks.gexf import write_gexf

    vertices, tree = forest(spark, sf)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}.gexf"
    write_gexf(vertices.select("id", G.xml_escape(F.col("title")).alias("title")), tree, path, weighted=False)
    return spark.read.text(path)


# ---- sinks, and what SQL does not say --------------------------------------------------------------------------


def _through(spark, sf, write, read) -> DataFrame:
    from quire.scratch import scratch_dir

    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    rows = pages(spark, sf)
    write(rows, path)
    return read(spark.read.schema(rows.schema), path)


@query("tsv_roundtrip", f"WITH {_PAGES} SELECT * FROM pages")
def tsv_roundtrip(spark, sf):
    from quire.sinks.tables import write_table

    return _through(spark, sf, lambda rows, path: write_table(rows, path, "csv"), lambda r, path: r.option("delimiter", "\t").option("quote", "").csv(path))


@query("parquet_roundtrip", f"WITH {_PAGES} SELECT * FROM pages")
def parquet_roundtrip(spark, sf):
    from quire.sinks.tables import write_table

    return _through(spark, sf, lambda rows, path: write_table(rows, path, "parquet"), lambda r, path: r.parquet(path))


@query("json_roundtrip", f"WITH {_PAGES} SELECT * FROM pages")
def json_roundtrip(spark, sf):
    from quire.sinks.tables import write_json

    return _through(spark, sf, write_json, lambda r, path: r.json(path))


@query("store_series", """SELECT user_id AS page_id, count(DISTINCT date_trunc('hour', ts)) AS n, count(*) AS total FROM events WHERE event_type = 'view' AND ts >= DATE '2024-01-11' AND ts < DATE '2024-01-21' GROUP BY 1""")
def store_series(spark, sf):
    """Series of one language and period from a store that is opened by its path, once what it covers is found to hold the period."""
    from quire.scratch import scratch_dir
    from quire.sinks.visits import load_series, open_store, save

    base = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    save(open_store(spark, base), visits_by_type(spark, sf), START, END)
    found = load_series(open_store(spark, base), MIDDLE, date(2024, 1, 20), "view")
    total = F.aggregate("visits", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return found.select("page_id", F.size("visits").cast("long").alias("n"), total.alias("total"))


@query("sink_roundtrip", f"""WITH {_VISITS} SELECT 'en' AS languageCode, page_id, visit_time, "count" FROM visits""")
def sink_roundtrip(spark, sf):
    """Visits through the store and back: two halves, the second written twice, days put together, half of them from an older snapshot."""
    from quire.scratch import scratch_dir
    from quire.sinks.visits import SnapshotVisitStore, load_period

    v = written(visits(spark, sf), "visits")
    store = SnapshotVisitStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    store.commit(V.in_period(v, START, MIDDLE), [(START, MIDDLE)], "first")
    for _ in range(2):
        store.commit(V.in_period(v, MIDDLE + timedelta(days=1), END), [(MIDDLE + timedelta(days=1), END)], "second")
    store.compact(pieces=1)
    return load_period(store, START, END)


@query("stl_trend")
def stl_trend(spark, sf):
    d = V.dense(visits(spark, sf), START, END).select("page_id", X.trend_of("values").alias("trend"))
    return d.select("page_id", F.posexplode("trend").alias("hour", "trend"))


def _shelves(spark, sf) -> DataFrame:
    """All visits, added up over the pages of each of twenty-five shelves: a single page has too few visits for a trend."""
    v = visits(spark, sf).withColumn("page_id", F.col("page_id") % 25)
    return v.groupBy("languageCode", "page_id", "visit_time").agg(F.sum("count").cast("int").alias("count"))


@query("zscore_peaks")
def zscore_peaks(spark, sf):
    return P.zscore_pages(_shelves(spark, sf), START, MIDDLE, END, 72, 3.0, 0.01, 1)


_ZSCORE_HOURS = f"""WITH RECURSIVE {_VISITS}, {_GRID}, series AS (SELECT page_id, list(CAST(c AS DOUBLE) ORDER BY hour) AS y, greatest(max(c), 1) * 1e-9 AS least FROM grid GROUP BY 1),
    walk(page_id, i, w, mark) AS (SELECT page_id, 71, y[1:72], 0 FROM series UNION ALL
        SELECT page_id, i + 1, (CASE WHEN len(w) > 72 THEN w[2:] ELSE w END) || [CASE WHEN mark <> 0 THEN 0.01 * v + 0.99 * w[-1] ELSE v END], mark FROM (
            SELECT page_id, i, w, v, CASE WHEN abs(v - list_avg(w[1:72])) <= greatest(3 * list_aggregate(w[1:72], 'stddev_samp'), least) THEN 0 WHEN v > list_avg(w[1:72]) THEN 1 ELSE -1 END AS mark
            FROM (SELECT walk.page_id, i, w, y[i + 2] AS v, least FROM walk JOIN series USING (page_id) WHERE i < {HOURS - 2})))
    SELECT page_id, CAST(count(*) AS INTEGER) AS active_hours FROM walk WHERE mark > 0 AND i >= 240 GROUP BY page_id"""


@query("zscore_hours", _ZSCORE_HOURS)
def zscore_hours(spark, sf):
    """Peaks of the hourly series themselves, from the tenth day on."""
    hours = X.active_hours_of(72, 3.0, 0.01, period_hours(START, date(2024, 1, 10)))
    return V.dense(visits(spark, sf), START, END).select("page_id", hours("values").alias("active_hours")).where("active_hours > 0")


@query("zscore_resumed", _ZSCORE_HOURS)
def zscore_resumed(spark, sf):
    """The same peaks from a state that is gone on with: the first nine days, a day, two days, and the rest."""
    from quire.scratch import scratch_dir
    from quire.sinks.zscores import ZScoreStore

    store, v = ZScoreStore(spark, f"{scratch_dir(spark)}/zscores-{uuid.uuid4().hex}", START), written(visits(spark, sf), "visits")
    ends = [date(2024, 1, 9), date(2024, 1, 10), date(2024, 1, 12), END]
    for start, end in zip([START, *(date(2024, 1, d) for d in (10, 11, 13))], ends, strict=True):
        store.extend(v, start, end)
    return store.active_hours(period_hours(START, date(2024, 1, 10)), *ends)


_LATE = period_hours(MIDDLE, END)


@query("peak_pipeline_raw", f"""WITH RECURSIVE {_PAGES}, {_LINKS}, {_REDIRECTS}, {_RESOLVED}, {_HOPS}, {_SUBSTITUTE}, {_VISITS}, {_GRID}, {_STATS},
    limits AS (SELECT page_id, mean + 3 * sqrt(variance) AS threshold FROM stats),
    burst AS (SELECT page_id FROM visits JOIN limits USING (page_id) WHERE visit_time >= DATE '2024-01-11' AND "count" > threshold GROUP BY 1 HAVING count(*) > 1),
    late AS (SELECT page_id, visit_time, CAST("count" AS DOUBLE) AS c FROM visits WHERE visit_time >= DATE '2024-01-11' AND page_id IN (SELECT page_id FROM burst)),
    days AS (SELECT page_id, CAST(visit_time AS DATE) AS d, sum(c) AS n FROM late GROUP BY 1, 2),
    busy AS (SELECT page_id FROM days GROUP BY 1 HAVING max(n) >= 4),
    nodes AS (SELECT id FROM pages WHERE id IN (SELECT page_id FROM burst) AND namespace <> 14),
    near AS (SELECT DISTINCT least("from", dest) AS src, greatest("from", dest) AS dst FROM direct WHERE "from" IN (SELECT id FROM nodes) AND dest IN (SELECT id FROM nodes)),
    sums AS (SELECT page_id, sum(c) AS s, sum(c * c) AS q FROM late WHERE page_id IN (SELECT page_id FROM busy) GROUP BY 1),
    products AS (SELECT src, dst, sum(x.c * y.c) AS p FROM near JOIN late x ON x.page_id = src JOIN late y ON y.page_id = dst AND y.visit_time = x.visit_time GROUP BY 1, 2),
    weights AS (SELECT src, dst, {_LATE} * ({_LATE} * p - x.s * y.s) / sqrt(({_LATE} * x.q - x.s * x.s) * ({_LATE} * y.q - y.s * y.s)) AS weight
        FROM products JOIN sums x ON x.page_id = src JOIN sums y ON y.page_id = dst),
    kept AS (SELECT * FROM weights WHERE weight > 1),
    both_ways AS (SELECT src AS a, dst AS b FROM kept UNION SELECT dst, src FROM kept),
    reach(id, other) AS (SELECT a, a FROM both_ways UNION SELECT id, b FROM reach JOIN both_ways ON a = other),
    parts AS (SELECT id, min(other) AS component FROM reach GROUP BY 1),
    best AS (SELECT component FROM parts GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
    SELECT src, dst, round(weight, 6) AS weight FROM kept JOIN parts ON id = src JOIN best USING (component)""")
def peak_pipeline_raw(spark, sf):
    """peak_pipeline on the hourly visits themselves, in place of their trends."""
    v = written(visits(spark, sf), "visits")
    active = written(P.burst_pages(v, START, MIDDLE, END, 3.0, 1), "active")
    shapes = P.active_series(v, active, MIDDLE, END, 4).select("page_id", X.standard(F.col("values")).alias("shape"))
    nodes, found = G.active_subgraph(pages(spark, sf), _direct(spark, sf), active)
    graph = P.peak_graph_of(written(nodes, "nodes"), found, shapes, _LATE, 1.0)[1]
    return graph.select("src", "dst", F.round("weight", 6).alias("weight"))


@query("peak_pipeline")
def peak_pipeline(spark, sf):
    """The graph of pages active together, from visits and resolved links."""
    v = visits(spark, sf)
    active = written(P.burst_pages(v, START, MIDDLE, END, 3.0, 1), "active")
    series = P.active_series(v, active, MIDDLE, END, 4)
    p = pages(spark, sf)
    nodes, found = G.active_subgraph(p, _direct(spark, sf), active)
    return P.peak_graph(nodes, found, series, period_hours(MIDDLE, END), 1.0)[1]
