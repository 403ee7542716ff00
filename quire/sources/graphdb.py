"""Page graphs held in a graph database.

read_graph reads whole tables through the database's Spark connector, whose jar it
needs. GraphDatabase asks for the pages and links of a list of ids alone, over the
database's HTTP interface: the list stays a table, each task asks for its own ids,
some at a time, and nothing of it passes through the driver.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMAT = "org.neo4j.spark.DataSource"
#: What the pages and links of some ids are asked with.
PAGES_OF = "MATCH (p:Page) WHERE p.id IN $ids RETURN p.id, p.title, CASE WHEN 'Category' IN labels(p) THEN 14 ELSE 0 END"
LINKS_OF = "MATCH (a:Page)-[r]->(b:Page) WHERE a.id IN $ids RETURN a.id, b.id"


def _read(spark: SparkSession, **options: str) -> DataFrame:
    try:
        return spark.read.format(_FORMAT).options(**options).load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e):
            raise RuntimeError("the Neo4j connector is not on the class path; add its package to the session") from e
        raise


def read_graph(spark: SparkSession, url: str, user: str, password: str) -> tuple[DataFrame, DataFrame]:
    """(pages (id, title, namespace), links (from, dest)): whole tables, filtered by joins afterwards."""
    login = {"url": url, "authentication.basic.username": user, "authentication.basic.password": password}
    pages = _read(spark, **login, query="MATCH (p:Page) RETURN p.id AS id, p.title AS title, CASE WHEN 'Category' IN labels(p) THEN 14 ELSE 0 END AS namespace")
    links = _read(spark, **login, query="MATCH (a:Page)-[r]->(b:Page) RETURN a.id AS `from`, b.id AS dest")
    return pages, links


@dataclass(frozen=True)
class GraphDatabase:
    """url: of the HTTP interface. per_query: ids asked for at once. connections: tasks that ask at a time."""

    url: str
    user: str | None = None
    password: str | None = None
    database: str = "neo4j"
    per_query: int = 1000
    connections: int = 16
    timeout: float = 300.0

    @classmethod
    def of_settings(cls, cfg: dict) -> GraphDatabase | None:
        """From the settings graph.*; None if they name no url."""
        if not cfg.get("graph.url"):
            return None
        named = {k: str(cfg[f"graph.{k}"]) for k in ("user", "password", "database") if f"graph.{k}" in cfg}
        return cls(str(cfg["graph.url"]), **named)

    def ask(self, statement: str, ids: list[int]) -> list[list]:
        """The rows that a statement gives for some ids; an error of the database is an error."""
        body = json.dumps({"statements": [{"statement": statement, "parameters": {"ids": ids}}]}).encode()
        headers = {"Content-Type": "application/json", "Accept": "application/json"}
        if self.user is not None:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/db/{self.database}/tx/commit", body, headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        if found.get("errors"):
            raise RuntimeError(f"the graph database says: {found['errors'][0].get('message')}")
        return [x["row"] for x in found["results"][0]["data"]]

    def _asked(self, ids: DataFrame, statement: str, schema: str, kinds: list[pa.DataType]) -> DataFrame:
        names = [c.split()[0].strip("`") for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[int] = []
            for batch in batches:
                held += batch.column(0).to_pylist()
                while len(held) >= self.per_query:
                    yield answer(held[: self.per_query])
                    del held[: self.per_query]
            if held:
                yield answer(held)

        def answer(some: list[int]) -> pa.RecordBatch:
            rows = self.ask(statement, some)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        return ids.mapInArrow(run, schema)

    def subgraph(self, active: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pages (id, title, namespace), links (from, dest)) of the active pages (page_id) and between them."""
        ids = active.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("id")).distinct().repartition(self.connections, "id")
        pages = self._asked(ids, PAGES_OF, "id bigint, title string, namespace int", [pa.int64(), pa.string(), pa.int32()])
        links = self._asked(ids, LINKS_OF, "`from` bigint, dest bigint", [pa.int64(), pa.int64()])
        return pages, links.join(ids.withColumnRenamed("id", "dest"), "dest", "left_semi").select("from", "dest")
