"""Page-view files: one line per page, project and access method, with hourly codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas as S
from quire.functions.dates import views_file

#: The two line formats.
CURRENT = r"^([a-z]{2}\.[a-z]+) (.*?) (\d+|null) (.*?) (\d+) ((?:[A-Z]\d+)+)$"
LEGACY = r"^([a-z]{2}\.[a-z]) (.*?) (\d+) ((?:[A-Z]\d+)+)$"
_NAMESPACES = {"Page": S.PAGE_NS, "Category": S.CATEGORY_NS, "Book": S.BOOK_NS}


def _namespace(title: Column) -> Column:
    prefix = F.substring_index(title, ":", 1)
    known = F.coalesce(*[F.when(prefix == p, F.lit(n)) for p, n in _NAMESPACES.items()], F.lit(S.OTHER_NS))
    return F.when(F.contains(title, F.lit(":")), known).otherwise(S.PAGE_NS)


def _stripped(title: Column) -> Column:
    return F.when(F.contains(title, F.lit(":")), F.expr("substring(_title, instr(_title, ':') + 1)")).otherwise(title)


def parse_views(lines: DataFrame, legacy: bool = False, languages: list[str] | None = None, project: str | None = None, strip_namespace: bool | None = None, decode_titles: bool = False) -> DataFrame:
    """Page views of text lines (column value); other columns follow. Lines that start with # are skipped.

    languages: the codes kept (None: all). project: keep one project's lines, such
    as "wikipedia"; by default all projects of a language count together.
    strip_namespace: drop the prefix of titles; by default only the legacy format
    does. decode_titles: undo URL escapes; by default only in a title that is one
    escape as a whole, in the legacy format.
    """
    pattern = LEGACY if legacy else CURRENT
    others = [c for c in lines.columns if c != "value"]
    rows = lines.where(~F.col("value").startswith("#")).where(F.col("value").rlike(pattern))
    group = lambda n: F.regexp_extract("value", pattern, n)
    daily, code = (3, 4) if legacy else (5, 6)
    title = group(2)
    if decode_titles:
        title = F.coalesce(F.try_url_decode(title), title)
    elif legacy:
        title = F.when(title.rlike(r"^%[A-F\d]{2}$"), F.coalesce(F.try_url_decode(title), title)).otherwise(title)
    rows = rows.select(
        group(1).alias("_project"), title.alias("_title"), F.lit("web").alias("source") if legacy else group(4).alias("source"),
        group(daily).try_cast("int").alias("dailyVisits"), group(code).alias("hourlyVisits"), *others,
    )
    if project:
        rows = rows.where(F.split_part("_project", F.lit("."), F.lit(2)) == project)
    strip = legacy if strip_namespace is None else strip_namespace
    rows = rows.select(
        F.substring_index("_project", ".", 1).alias("languageCode"), (_stripped(F.col("_title")) if strip else F.col("_title")).alias("title"),
        _namespace(F.col("_title")).alias("namespace"), "source", "dailyVisits", "hourlyVisits", *others,
    ).where("dailyVisits IS NOT NULL")
    if legacy:
        rows = rows.where(F.col("namespace").isin(*S.KEPT_NAMESPACES))
    return rows if languages is None else rows.where(F.col("languageCode").isin(*languages))


def view_date(file_name: Column) -> Column:
    """The date in the name of a page-view file of either format."""
    digits = F.regexp_replace(F.regexp_extract(file_name, r"(?:pagecounts|pageviews)-(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def read_views(spark: SparkSession, base: str, days: list, legacy: bool = False, **options) -> DataFrame:
    """Page views of one file per day, in one scan, with the column date."""
    lines = spark.read.text([views_file(base, d, legacy) for d in days])
    lines = lines.select("value", view_date(F.col("_metadata.file_name")).alias("date"))
    return parse_views(lines, legacy, **options)
