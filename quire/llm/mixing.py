"""Mixing sources to target weights by a low-discrepancy schedule.

A source's target in words becomes a quota of blocks of block_words words. The
quotas, laid end to end in the order of the sources, are the cumulative weights.
Slot k of the mix lies at the fractional part of (k + 1) times the golden ratio;
the source in whose stretch that point falls owns the slot. The r-th slot of a
source takes the r-th block of the source's documents, laid end to end in the
order of a hash: once, and once more in another order where the target exceeds
the source. Slots of a source whose quota is filled stay unused. Any 1.9 / w
points in a row hit a stretch of weight w, so twice as many slots as blocks fill
every quota; points are 62-bit integers, so this holds at any number of slots.
The last block of a source is cut at its target.

All ranks and running sums are built in two levels (inside chunks of bounded
size, then over chunks), so a source with a third of all rows is no hot key, and
the table of sources is never gathered in one place.

Rows: every input row is one document; documents without words take nothing.
A null source is a source of its own, the last. Repeated rows count as rows of
their own, and rows that are equal in everything share their words in any order.
Ties of the hash are broken by a hash of the whole row. Sources without words
have target 0. Null ids are ids like others. An empty table gives an empty
result. Extra columns are ignored by mix and kept by mixed_documents, whatever
their names. Texts are read whole; long ones lie in many blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, own_column, require, whole_row, written

BLOCK_WORDS = 256
SHARE = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
#: Rows of one source that one running sum covers, on average.
CHUNK_ROWS = 4_096
#: Slots that one rank covers, and numbers that one task counts up.
CHUNK_SLOTS = 8_192
#: Sources that are broadcast; more than that are joined.
BROADCAST_SOURCES = 100_000
#: The golden ratio's fractional part times 2**62, and the half of its bits.
GOLDEN = int(0x9E3779B97F4A7C15 >> 2)
_HALF = 31


def words_of(text: Column) -> Column:
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _counted(df: DataFrame, lo: str, hi: str, out: str, *keys: str) -> DataFrame:
    """A row for each whole number from lo to hi - 1, as column out; long ranges are dealt to many tasks."""
    some = df.where(F.col(lo) < F.col(hi)).withColumn("_from", F.explode(F.sequence(F.col(lo), F.col(hi) - 1, F.lit(CHUNK_SLOTS).cast("long"))))
    some = some.repartition(*keys, "_from")
    return some.withColumn(out, F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK_SLOTS, F.col(hi)) - 1))).drop("_from")


def _running(df: DataFrame, group: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over the rows before, in the order of chunk and then order, within each group."""
    df = df.withColumn("_value", value)
    totals = df.groupBy(*group, chunk).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_off", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return df.join(bases, [*group, chunk]).withColumn(out, F.col("_base") + F.col("_off")).drop("_value", "_off", "_base")


def keyed(docs: DataFrame, id_col: str, same: list[str]) -> DataFrame:
    """(id, source, size, k1, k2, nth): k1 and k2 are hashes of the columns same, nth numbers the rows that are equal in them."""
    rows = docs.select(docs[id_col].alias("id"), docs["source"].alias("source"), words_of(docs["text"]).alias("size"), *hashes(docs, same))
    counts = rows.groupBy("id", "source", "size", "k1", "k2").agg(F.count("*").alias("_n")).withColumn("_lo", F.lit(0).cast("long"))
    single = counts.where("_n = 1").select("id", "source", "size", "k1", "k2", F.col("_lo").alias("nth"))
    return single.unionByName(_counted(counts.where("_n > 1"), "_lo", "_n", "nth", "k1", "k2").select(*single.columns))


def hashes(docs: DataFrame, same: list[str]) -> list[Column]:
    def plain(c: str) -> Column:
        own = own_column(docs, c)
        return F.to_json(F.struct(own)) if isinstance(docs.schema[c].dataType, T.MapType) else own

    parts = [x for c in same for x in (own_column(docs, c).isNull(), plain(c))]
    return [F.xxhash64(F.lit(n), *parts).alias(f"k{n}") for n in (1, 2)]


@dataclass
class Sources:
    table: DataFrame  # source, n, size, source_no, target, goal (whole words), quota, lo, hi (cumulative blocks)
    blocks: int
    few: bool

    def hinted(self) -> DataFrame:
        return F.broadcast(self.table) if self.few else self.table


def source_targets(sized: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> Sources:
    """The sources in code point order, null last, with their targets and their stretches of blocks.

    Targets are share times all sizes by weight, none above most times its size:
    what a stopped source leaves is shared among the others by weight, until none
    is above. They fall short of the whole only if all are stopped. A source is
    stopped where its part of what is left, by the weights of those that are not
    stopped, is too much; both figures settle in rounds of one sum over the
    sources. Places in the order come from a range sort: part, then row in it.
    """
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    last = F.col("source").isNull()
    found = found.repartitionByRange(last, F.col("source")).sortWithinPartitions(last, F.col("source"))
    row = F.monotonically_increasing_id()
    found = written(found.select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    found = _running(found, [], "part", ["at"], F.lit(1).cast("long"), "source_no")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))).cast("int"))
    found = written(found.withColumn("weight", weight), "ranked")
    whole, words, count = found.where("size > 0").agg(F.sum("weight"), F.sum("size"), F.count("*")).first()
    left, open_weight, stopped = share * (words or 0), whole or 0.0, -1
    while True:
        part = F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight or 1.0))
        over = part > most * F.col("size")
        n, their_words, their_weight = found.where("size > 0").where(over).agg(F.count("*"), F.sum("size"), F.sum("weight")).first()
        if n == stopped or n == 0 or n == count:
            break
        stopped, left, open_weight = n, share * words - most * their_words, whole - their_weight
    target = F.when(F.col("size") == 0, 0.0).when(over, most * F.col("size").cast("double")).otherwise(part)
    found = found.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    found = found.withColumn("quota", F.ceil(F.col("goal") / block_words).cast("long"))
    found = _running(found, [], "part", ["at"], F.col("quota"), "lo").withColumn("hi", F.col("lo") + F.col("quota"))
    found = written(found.select("source", "n", "size", "source_no", "target", "goal", "quota", "lo", "hi"), "targets")
    rows, blocks = found.agg(F.count("*"), F.sum("quota")).first()
    return Sources(found, blocks or 0, rows <= BROADCAST_SOURCES)


def place_of(slot: Column, blocks: int) -> Column:
    """The block, among all stretches, that the slot's golden-ratio point falls on."""
    mask = F.lit((1 << _HALF) - 1).cast("long")
    k = slot.cast("long") + 1
    k1, k0 = F.shiftright(k, _HALF), k.bitwiseAND(mask)
    g1, g0 = F.lit(GOLDEN >> _HALF).cast("long"), F.lit(GOLDEN & ((1 << _HALF) - 1)).cast("long")
    # k * GOLDEN modulo 2**62, no product of which leaves 63 bits.
    high = (k1 * g0).bitwiseAND((1 << 62) - 1) + k0 * g1
    low = k0 * g0
    point = F.shiftleft((high + F.shiftright(low, _HALF)).bitwiseAND(mask), _HALF) + low.bitwiseAND(mask)
    wide = point.cast("decimal(19,0)") * F.lit(blocks).cast("decimal(18,0)")
    return F.call_function("div", wide, F.lit(1 << 62).cast("decimal(19,0)")).cast("long")


def schedule(df: DataFrame, sources: Sources, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, rank, words): which block each slot takes."""
    blocks = sources.blocks
    slots = df.sparkSession.range(2 * blocks + 64 if blocks else 0).select(F.col("id").alias("slot"), place_of(F.col("id"), blocks).alias("place"))
    owners = _counted(sources.table.select("source_no", "goal", "quota", "lo", "hi"), "lo", "hi", "place", "source_no").select("place", "source_no", "goal", "quota")
    # Spark takes what a few sources are counted out to for as small as they are: never broadcast it.
    owned = slots.join(owners.hint("merge"), "place").withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    ranked = _running(owned, ["source_no"], "chunk", ["slot"], F.lit(1).cast("long"), "rank").where("rank < quota")
    words = F.least(F.lit(block_words).cast("long"), F.col("goal") - F.col("rank") * block_words).alias("words")
    return ranked.select("slot", "source_no", "rank", words)


def laid_out(sized: DataFrame, sources: Sources) -> DataFrame:
    """(k1, k2, nth, source_no, pass, at, size): where each document's words lie in its source's shuffled stream.

    The stream holds all documents of a source, and all once more in another
    order where the target is above the source's size.
    """
    own = sources.hinted().where("goal > 0").select(F.col("source").alias("own"), "source_no", F.col("size").alias("source_size"), "goal", F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"))
    rows = sized.where("size > 0").join(own, F.col("source").eqNullSafe(F.col("own")))
    passes = F.when(F.col("goal") > F.col("source_size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("id", "k1", "k2", "nth", "source_no", "size", "chunks", F.explode(passes).alias("pass"))
    rows = rows.withColumn("order", F.conv(F.substring(F.md5(F.concat_ws(":", "pass", "id", "size", "nth").cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("chunk", F.col("pass") * F.col("chunks") + F.floor(F.col("order").cast("double") / F.lit(2.0**60) * F.col("chunks")))
    rows = _running(rows, ["source_no"], "chunk", ["order", "k1", "k2", "nth"], F.col("size"), "at")
    return rows.select("k1", "k2", "nth", "source_no", "pass", "at", "size")


KEY = ["k1", "k2", "nth"]


def mix(docs: DataFrame, id_col: str = "doc_id", block_words: int = BLOCK_WORDS, same: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per document, pieces).

    Per document: id, size, source, source_size, target, taken, first_slot (null
    if nothing is taken). Pieces: k1, k2, nth (the row, see keyed), pass, slot,
    first and taken: the words from first on that the slot takes.
    """
    require(docs, id_col, "text", "source")
    sized = written(keyed(docs, id_col, same or list(dict.fromkeys([id_col, "source", "text"]))), "sizes")
    sources = source_targets(sized, block_words)
    slots = schedule(sized, sources, block_words)
    stream = laid_out(sized, sources)
    blocks = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    joined = blocks.join(slots, ["source_no", "rank"])
    start = F.greatest(F.col("at"), F.col("rank") * block_words)
    stop = F.least(F.col("at") + F.col("size"), F.col("rank") * block_words + F.col("words"))
    pieces = joined.select(*KEY, "pass", "slot", (start - F.col("at")).alias("first"), (stop - start).alias("taken")).where("taken > 0")
    taken = pieces.groupBy(*KEY).agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    own = sources.hinted().select(F.col("source").alias("own"), F.col("size").alias("source_size"), "target")
    per = sized.join(own, F.col("source").eqNullSafe(F.col("own"))).join(taken, KEY, "left")
    return per.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot"), pieces


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, in the order of the schedule: a row for each pass that takes words of a document.

    Rows have the columns of docs. A document that is taken in part keeps its
    text from the first word taken up to the last; whole ones keep their whole
    text. n_chars, if there, follows the text. Rows come in the order of the first
    slot that takes of them.
    """
    _, pieces = mix(docs, same=docs.columns)
    parts = written(pieces.groupBy(*KEY, "pass").agg(F.min("slot").alias("slot"), F.min("first").alias("first"), F.sum("taken").alias("taken")), "parts")
    # Everything of docs in one column, so that no name of its can clash.
    rows = docs.select(whole_row(docs).alias("row"), docs["text"].alias("text"), *hashes(docs, docs.columns))
    if not parts.where("nth > 0").isEmpty():
        rows = rows.groupBy("k1", "k2").agg(F.first("row").alias("row"), F.first("text").alias("text"))  # equal in everything
    rows = rows.join(parts, ["k1", "k2"])
    # Up to the end of the last word taken: what lies before each word goes with it.
    begins = F.regexp_extract_all("text", F.lit(f"(\\s*{WORD})"), F.lit(1))
    part = F.array_join(F.slice(begins, F.col("first").cast("int") + 1, F.col("taken").cast("int")), "")
    rows = rows.withColumn("new", F.when((F.col("first") > 0) | (F.col("taken") < words_of(F.col("text"))), part).otherwise(F.col("text")))
    rows = rows.orderBy("slot", "pass", *KEY)
    length = lambda c: F.length("new").cast(docs.schema[c].dataType)
    return rows.select(*[(F.col("new") if c == "text" else length(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])
