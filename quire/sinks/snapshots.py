"""The visit table as a series of snapshots.

A commit writes rows into a folder of its own and then a manifest: which folders
make up the table, with the rows of each of their days, and which periods are
covered. A manifest appears whole or not at all, so rows and coverage become
visible together, and a reader keeps the snapshot it began with while others are
written. The newest manifest is found from one pointer file; a period's read
lists the folders of its own days alone, however many writes there were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas as S
from quire.sinks.files import delete_folder, list_names, put_text_file, read_text_file

_STORED = T.StructType([*[f for f in S.VISIT_ROW.fields if f.name != "languageCode"], T.StructField("batch", T.StringType())])
_READ = T.StructType([*_STORED.fields, T.StructField("commit", T.StringType()), T.StructField("visit_date", T.DateType()), T.StructField("languageCode", T.StringType())])
EMPTY = {"version": 0, "parts": [], "covers": []}


class SnapshotVisitStore:
    """parts of a manifest: {commit, batches, gone, days: {day: rows}}; covers: {batch, start, end}.

    batch names a write: a second one of the same name takes the place of the
    first, rows and coverage. gone: batches of a part that have been replaced since
    it was put together; their rows stay in its files and are not read.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # ---- manifests ----

    def _manifest(self, version: int) -> str:
        return f"{self.base}/manifests/{version:012d}.json"

    def snapshot(self, version: int | None = None) -> dict:
        """A manifest: the newest, or that of a version."""
        if version is None:
            # The pointer may lag behind a commit, never lead: what follows it is tried. Only without it is the folder listed.
            pointer = read_text_file(self.spark, f"{self.base}/current")
            version = int(pointer) if pointer else max((int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.base}/manifests") if n.endswith(".json") and n[0] != "."), default=1)
            newest = EMPTY
            while text := read_text_file(self.spark, self._manifest(version)):
                newest, version = json.loads(text), version + 1
            return newest
        if not version:
            return EMPTY
        text = read_text_file(self.spark, self._manifest(version))
        if text is None:
            raise ValueError(f"there is no snapshot {version}")
        return json.loads(text)

    def _commit(self, change: Callable[[dict], dict]) -> dict:
        """Put a changed manifest after the newest; if another commit came first, change that one."""
        while True:
            old = self.snapshot()
            new = change(json.loads(json.dumps(old))) | {"version": old["version"] + 1}
            if put_text_file(self.spark, self._manifest(new["version"]), json.dumps(new), replace=False):
                put_text_file(self.spark, f"{self.base}/current", str(new["version"]), replace=True)
                return new

    # ---- reading ----

    def paths(self, start: date | None = None, end: date | None = None, version: int | None = None) -> list[tuple[str, tuple[str, ...]]]:
        """(folder, batches not to read) of every part's days in a period."""
        inside = lambda d: (start is None or d >= str(start)) and (end is None or d <= str(end))
        return [(f"{self.base}/data/commit={p['commit']}/visit_date={d}", tuple(p["gone"])) for p in self.snapshot(version)["parts"] for d in p["days"] if inside(d)]

    def _read(self, chosen: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        """(visit columns, batch, visit_date) of day folders."""
        by_gone: dict[tuple[str, ...], list[str]] = {}
        for path, gone in chosen:
            by_gone.setdefault(gone, []).append(path)
        whole = None
        for gone, some in by_gone.items():
            rows = self.spark.read.schema(_READ).option("basePath", f"{self.base}/data").parquet(*some)
            rows = rows.where(~F.col("batch").isin(*gone)) if gone else rows
            rows = rows.select(*S.VISIT_ROW.fieldNames(), "batch", "visit_date")
            whole = rows if whole is None else whole.unionByName(rows)
        kinds = T.StructType([*S.VISIT_ROW.fields, T.StructField("batch", T.StringType()), T.StructField("visit_date", T.DateType())])
        return self.spark.createDataFrame([], kinds) if whole is None else whole

    def visits(self, start: date | None = None, end: date | None = None, version: int | None = None) -> DataFrame:
        return self._read(self.paths(start, end, version)).select(S.VISIT_ROW.fieldNames())

    def meta(self, version: int | None = None) -> DataFrame:
        rows = [tuple(datetime.combine(date.fromisoformat(c[k]), time()) for k in ("start", "end")) for c in self.snapshot(version)["covers"]]
        return self.spark.createDataFrame(rows, S.VISIT_META)

    # ---- writing ----

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows with batch and visit_date into a folder of their own: its name, and the rows of each day."""
        commit = uuid.uuid4().hex
        folder = f"{self.base}/data/commit={commit}"
        rows = rows.select(*S.VISIT_ROW.fieldNames(), "batch", "visit_date")
        rows.hint("rebalance", "visit_date", "languageCode").write.partitionBy("visit_date", "languageCode").parquet(folder)
        kinds = T.StructType([f for f in _READ.fields if f.name != "commit"])
        counts = self.spark.read.schema(kinds).parquet(folder).groupBy("visit_date").agg(F.count("*").alias("n"))
        return commit, {str(r.visit_date): r.n for r in counts.collect()}

    def commit(self, rows: DataFrame | None, covers: list[tuple[date, date]], batch: str | None = None) -> dict:
        """Add rows and the periods they cover, as one snapshot; returns its manifest."""
        batch = batch or uuid.uuid4().hex
        made = self._write(rows.select(*S.VISIT_ROW.fieldNames(), F.lit(batch).alias("batch"), F.to_date("visit_time").alias("visit_date"))) if rows is not None else None

        def change(m: dict) -> dict:
            if made is not None:
                m["parts"] = self._without(m["parts"], batch)
                if made[1]:
                    m["parts"].append({"commit": made[0], "batches": [batch], "gone": [], "days": made[1]})
                m["covers"] = [c for c in m["covers"] if c["batch"] != batch]
            new = [{"batch": batch, "start": str(a), "end": str(b)} for a, b in covers]
            m["covers"] = [c for c in m["covers"] if c not in new] + new
            return m

        return self._commit(change)

    @staticmethod
    def _without(parts: list[dict], batch: str) -> list[dict]:
        kept = []
        for p in parts:
            if batch in p["batches"]:
                p = p | {"batches": [b for b in p["batches"] if b != batch], "gone": [*p["gone"], batch]}
            if p["batches"]:
                kept.append(p)
        return kept

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        self.commit(rows, [], batch)

    def append_meta(self, start: date, end: date, batch: str | None = None) -> None:
        self.commit(None, [(start, end)], batch)

    # ---- upkeep ----

    def compact(self, pieces: int = 4) -> dict:
        """Put together the days that lie in at least so many parts; returns the manifest then valid.

        Rows keep the names of their batches. Commits that come in meanwhile stay
        as they are: only the parts that were read are taken out of the manifest.
        """
        old = self.snapshot()
        count: dict[str, int] = {}
        for p in old["parts"]:
            for d in p["days"]:
                count[d] = count.get(d, 0) + 1
        days = {d for d, n in count.items() if n >= pieces}
        if not days:
            return old
        used = [p for p in old["parts"] if days & set(p["days"])]
        chosen = [(f"{self.base}/data/commit={p['commit']}/visit_date={d}", tuple(p["gone"])) for p in used for d in p["days"] if d in days]
        commit, rows = self._write(self._read(chosen))
        read = {p["commit"]: p for p in used}

        def change(m: dict) -> dict:
            # A batch that was replaced since its rows were read is not to be read from the new part either.
            late = sorted({b for p in m["parts"] if p["commit"] in read for b in p["gone"] if b not in read[p["commit"]]["gone"]} | {b for c, p in read.items() if c not in {x["commit"] for x in m["parts"]} for b in p["batches"]})
            batches = sorted({b for p in used for b in p["batches"]} - set(late))
            kept = []
            for p in m["parts"]:
                rest = {d: n for d, n in p["days"].items() if p["commit"] not in read or d not in days}
                if rest:
                    kept.append(p | {"days": rest})
            m["parts"] = kept + ([{"commit": commit, "batches": batches, "gone": late, "days": rows}] if rows and batches else [])
            return m

        return self._commit(change)

    def vacuum(self, keep: int = 10) -> int:
        """Remove folders that none of the newest snapshots names, and older manifests; returns how many folders went.

        A reader of a snapshot older than these fails from then on, and so does a
        commit whose rows are being written: run it when none is.
        """
        newest = self.snapshot()["version"]
        versions = range(max(newest - keep + 1, 1), newest + 1)
        named = {p["commit"] for v in versions for p in self.snapshot(v)["parts"]}
        gone = [n for n in list_names(self.spark, f"{self.base}/data") if n.startswith("commit=") and n.removeprefix("commit=") not in named]
        for n in gone:
            delete_folder(self.spark, f"{self.base}/data/{n}")
        for n in list_names(self.spark, f"{self.base}/manifests"):
            if n.endswith(".json") and n[0] != "." and int(n.removesuffix(".json")) < versions.start:
                delete_folder(self.spark, f"{self.base}/manifests/{n}")
        return len(gone)
