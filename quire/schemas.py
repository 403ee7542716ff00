"""Schemas of all records, and the small enumerations. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: Namespaces that the operators know; OTHER_NS marks any other prefix.
OTHER_NS, PAGE_NS, CATEGORY_NS, PORTAL_NS, BOOK_NS = -1, 0, 14, 100, 108
KEPT_NAMESPACES = (PAGE_NS, CATEGORY_NS)


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    """Columns as "name type", comma-separated; needs no session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


PAGE = _schema("id int, namespace int, title string, restriction string, isRedirect boolean, isNew boolean, random double, touched timestamp, linksUpdated string, latest int, len int, contentModel string")
PAGE_LANG = T.StructType([*PAGE, T.StructField("languageCode", T.StringType())])
SIMPLE_PAGE = _schema("id int, title string, isRedirect boolean, isNew boolean")
PAGE_LINK = _schema("`from` int, namespace int, title string, fromNamespace int")
LANG_LINK = _schema("`from` int, lang string, title string")
REDIRECT = _schema("`from` int, targetNamespace int, title string, interwiki string, fragment string")
CATEGORY = _schema("id int, title string, pages int, subcats int, files int")
CATEGORY_LINK = _schema("`from` int, `to` string, sortKey string, timestamp timestamp, sortkeyPrefix string, collation string, ctype string")
PAGE_VIEW = _schema("languageCode string, title string, namespace int, source string, dailyVisits int, hourlyVisits string")
VISIT = _schema("time timestamp, count int, timeResolution string")
PAGE_VISITS = T.StructType([*_schema("languageCode string, title string, namespace int"), T.StructField("visits", T.ArrayType(VISIT))])
VISIT_ROW = _schema("languageCode string, page_id bigint, visit_time timestamp, count int")
VISIT_META = _schema("start_time timestamp, end_time timestamp")
