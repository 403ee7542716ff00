"""URL filters by Bloom filter cascades: exact membership without joins.

A cascade encodes which keys of a known universe are listed. Level 0 holds the
listed keys; level 1 those unlisted keys of the universe that level 0 lets
through; level 2 the listed keys that level 1 lets through; and so on until
nothing passes wrongly. A key of the universe is then looked up in bitmaps
alone: the first level that lacks it tells the answer. Here the universe is
every key that any url of the corpus can ask for, so all answers are exact.

A rule is a host with a path that ends in a slash; it covers its host, all
subdomains, and the paths that start with its path. A url asks for each suffix
of its host with each leading part of its path; the longest rule listed wins.

Rows: one output row per input row. A url that is null or lacks "://" has an
empty host and path and meets no rule. Repeated rows are judged alike, extra
columns, whatever their names, are dropped, an empty table gives an empty result.
Two rules never tie: of those that hold for a url the longer wins, and two of one
host and path must have one verdict. Urls are read whole, however long: one asks
for as many keys as its host has labels, times the slashes of the deepest rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All bitmaps of one cascade together, as they are in every worker; a larger list is joined instead.
MOST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """Every key a url asks for: suffixes of its host with leading parts of its path, to a depth of slashes."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    slashes = F.least(F.length(path) - F.length(F.translate(path, "/", "")), F.lit(depth))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(slashes, F.lit(1))), lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when((slashes >= 1) & (host != ""), keys).otherwise(F.array().cast("array<string>"))


@dataclass
class Level:
    seed: int
    bits: int
    hashes: int
    data: bytes = field(repr=False, default=b"")

    def positions(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, seed=self.seed)
        a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        data = self.data
        return all(data[p >> 3] >> (p & 7) & 1 for p in self.positions(key))


def _sized(seed: int, keys: int, rate: float) -> Level:
    bits = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))
    return Level(seed, -(-bits // 64) * 64, max(1, round(-math.log2(rate))))


class Cascade:
    """The levels; ``in`` is exact for the universe they were built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([k in level for k in batch.column(0).to_pylist()], pa.bool_()))

    return keys.select("key").mapInArrow(run, "key string")


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with its bitmap, packed; it is gathered as 64-bit words, and its size was checked before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(sorted({p for k in batch.column(0).to_pylist() for p in level.positions(k)}), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], ["word", "bit"])

    words = keys.select("key").mapInArrow(run, "word bigint, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bitmap = np.zeros(level.bits // 64, "<u8")
    for batch in words.toArrow().to_batches():
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    level.data = bitmap.tobytes()
    return level


def build_cascade(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade | None:
    """The cascade of the listed keys (column key) of a universe of distinct keys.

    None if its bitmaps would exceed most_bytes; then use a join. Every level
    halves what is left, so the levels end by themselves.
    """
    yes = written(universe.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    n_yes, n_all = yes.count(), universe.count()
    if not n_yes:
        return Cascade([])
    no, n_no, levels, room = universe.join(yes, "key", "left_anti"), n_all - n_yes, [], most_bytes * 8
    rate = min(0.5, n_yes / max(1, n_no) / math.sqrt(2))
    ins, outs, n = yes, no, n_yes
    while n:
        level = _sized(len(levels), n, rate if not levels else 0.5)
        room -= level.bits
        if room < 0:
            return None
        levels.append(_filled(ins, level))
        wrong = written(_passing(outs, level), "passing")
        ins, outs, n = wrong, ins, wrong.count()
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url.

    rules: (verdict, host, path). listed: keys (column key) blocked where no rule
    holds; like the rules they cover subdomains and deeper paths.
    """
    require(pages, "page_id", "url")
    if any(not p.startswith("/") or not p.endswith("/") for _, _, p in rules):
        raise ValueError("the path of a rule starts and ends with a slash")
    spark = pages.sparkSession
    if len({(h.translate(str.maketrans(UPPER, LOWER)), p) for _, h, p in rules}) < len({(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules}):
        raise ValueError("two rules of one host and path have different verdicts")
    verdicts = {h.translate(str.maketrans(UPPER, LOWER)) + p: v for v, h, p in rules}
    depth = max([p.count("/") for _, _, p in rules], default=1)
    if listed is not None:
        listed = written(listed.select("key").distinct(), "list")
        depth = max(depth, listed.agg(F.max(F.length("key") - F.length(F.translate("key", "/", "")))).first()[0] or 1)
    host, path = host_and_path(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), depth))
    universe = written(asked.select(F.explode("keys").alias("key")).distinct(), "keys")
    lists = {v: spark.createDataFrame([(k,) for k, x in verdicts.items() if x == v], "key string") for v in sorted(set(verdicts.values()))}
    if listed is not None:
        lists[""] = listed.select("key")
    cascades = {v: build_cascade(universe, keys, most_bytes) for v, keys in lists.items()}
    if any(c is None for c in cascades.values()):
        return _joined(asked, lists)
    levels = spark.sparkContext.broadcast({v: c.levels for v, c in cascades.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = {v: Cascade(x) for v, x in levels.value.items()}
        seen: dict[str, str | None] = {}

        def told(key: str) -> str | None:
            if key not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[key] = next((v for v, c in tests.items() if v and key in c), "" if "" in tests and key in tests[""] else None)
            return seen[key]

        for batch in batches:
            rules, verdict = [], []
            for keys in batch.column(3).to_pylist():
                found = [(len(k), k, v) for k in keys if (v := told(k)) is not None]
                best = max((x for x in found if x[2]), default=None)
                rules.append(best and best[1])
                verdict.append(best[2] if best else "block" if found else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rules, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(asked: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """The same answers by a join, for lists too large for bitmaps in memory."""
    told = None
    for v, keys in lists.items():
        some = keys.distinct().select("key", F.lit(v).alias("told"))
        told = some if told is None else told.unionByName(some)
    rows = asked.withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", F.explode("keys").alias("key")).join(told, "key")
    best = found.groupBy("row").agg(F.max(F.when(F.col("told") != "", F.struct(F.length("key").alias("n"), "key", "told"))).alias("best"), F.count("*").alias("n"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.told")).when(F.col("n") > 0, "block").otherwise("allow")
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))
