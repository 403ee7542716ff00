"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its distinct word shingles, held as 64-bit hashes made
of an XXH3 hash of every word; documents with equal sets are one class.
A class has a signature of COORDINATES minima and is posted under (coordinate,
value) pairs. Two sets with a similarity of 0.8 agree in 80% of the coordinates on
average; pairs that agree in at least MATCHES are retained. Postings carry two
bits of every coordinate, so that most chance meetings are dropped in the list,
before any signature is fetched. A pair at 0.8 exactly falls short of one of the
two tests with a chance below 1e-6, a more similar one with less (missed() works
it out). Prefix: a class is posted only under its COORDINATES - MATCHES + 1 rarest
pairs, since pairs with MATCHES in common must meet there. Skip: candidates in the
same component already need no count. Every retained pair is confirmed on full sets.

No list emits all its pairs. First every list links its members to its leaders;
what the full sets confirm is joined into components. Then only members of a
list that lie in different components are compared: all of them in lists of up
to SHORT_LIST members, a bounded number for each posting. The members of longer
lists meet once more in lists that are hardly ever long, under the rarest of their
shingles themselves: two sets of that similarity share one of the
n - ceil(0.8 n) + 1 rarest, for certain, and at the first they share enough of both
sets still has to follow. So beside the chance above no link that changes a
component is lost, whatever the length of a list. Skewed lists are split by
adaptive execution.

Rows: one output row per input row. A null or empty text, or one without words,
has an empty set and links with nothing; with fewer words than a shingle has,
the whole sequence is the one shingle. Repeated rows and ids link by their sets
like any others: rows of one id with different texts are different documents that
happen to have one number. Of ties for leader the lower hash leads. Extra columns,
whatever their names, are ignored by link_components and kept by one_of_each; an
empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, whole_row, whole_text, written
from .components import components
from .hashing import mixed

COORDINATES = 64
MATCHES = 32
#: Two bits of every coordinate go with a posting; pairs that agree in fewer of them are not looked at further.
SKETCH_MATCHES = 36
PERCENT = 80
#: Leaders of each list; after them only members of different components are compared.
LEADERS = 2
#: Members up to which a list's pairs are compared as they are.
SHORT_LIST = 32
#: Ids that are broadcast to pick their documents; more than that are joined.
BROADCAST_IDS = 1_000_000
#: Texts hashed at once.
BATCH_BYTES = 1 << 20

def missed(similarity: float = PERCENT / 100) -> float:
    """The chance that a pair of this similarity fails a test of its signatures."""
    below = lambda k, p: sum(math.comb(COORDINATES, i) * p**i * (1 - p) ** (COORDINATES - i) for i in range(k))
    return below(MATCHES, similarity) + below(SKETCH_MATCHES, similarity + (1 - similarity) / 4)


class Shingler:
    """Distinct shingle hashes of texts, and their signatures."""

    def __init__(self, words: int, coordinates: int = COORDINATES):
        self.words = words
        rng = np.random.default_rng(7)
        self.mask = rng.integers(0, 1 << 64, coordinates, np.uint64, endpoint=False)
        self.factor = rng.integers(0, 1 << 64, coordinates, np.uint64, endpoint=False) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        split = [x.lower().split() for x in texts]  # of bytes: ASCII letters and ASCII white space
        cut = np.cumsum([len(x) for x in split])
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), np.uint64, int(cut[-1]) if len(cut) else 0)
        n = self.words
        long = len(word) - n + 1
        if long > 0:
            shingle = word[:long].copy()
            for k in range(1, n):
                shingle = mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + word[k : k + long])
        out, at = [], 0
        for end in cut.tolist():
            if end - at >= n:
                out.append(np.unique(shingle[at : end - n + 1]))
            elif end > at:
                few = word[at : at + 1].copy()
                for k in range(at + 1, end):
                    few = mixed(few * np.uint64(0x9E3779B97F4A7C15) + word[k : k + 1])
                out.append(mixed(few ^ np.uint64(end - at)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = end
        return out

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = [((hashes ^ m) * f).min() for m, f in zip(self.mask, self.factor, strict=True)]
        return (mixed(np.array(low, np.uint64)) >> np.uint64(33)).astype(np.int32)


def _batches(texts: pa.Array) -> Iterator[list[bytes]]:
    some, size = [], 0
    for x in texts:
        some.append(x.as_py().encode())
        size += len(some[-1])
        if size >= BATCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, n_shingles, k1, k2, signature): k1 and k2 identify the whole set, mark the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            size, k1, k2, sig = [], [], [], []
            for texts in _batches(batch.column(2)):
                for s in shingler.sets(texts):
                    size.append(len(s))
                    k1.append(int(mixed(s).sum().view(np.int64)) if len(s) else 0)
                    k2.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(s) else 0)
                    sig.append(shingler.signature(s).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "mark", "n_shingles", "k1", "k2", "signature"])

    return marked(docs).mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, k1 bigint, k2 bigint, signature array<int>")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): whole texts, and a hash of each that tells the rows of one id apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("mark"), whole_text().alias("text"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the whole set of each text as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1)):
                sets = [x.tobytes() for x in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets, pa.binary())], ["id", "hashes"])
                at += len(texts)

    return docs.select("id", "text").mapInArrow(run, "id bigint, hashes binary")


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(value, id, n, s1, s2, common): each class under its rarest signature pairs, where another class is.

    n is the size of its set, s1 and s2 hold two bits of every coordinate, and
    common says how often its signature pairs stand in the corpus: of a group of
    near copies the one that the others were made from has the most.
    """
    pairs = classes.select("id", F.posexplode("signature").alias("coordinate", "value"))
    pairs = pairs.select("id", (F.shiftleft(F.col("value").cast("long"), 8) + F.col("coordinate")).alias("value"))
    often = pairs.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    shared = pairs.join(often, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("found"))
    # The pairs that only this class has are its rarest; they fill the prefix first.
    room = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("found"))
    common = F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    lists = shared.where(room > 0).select("id", common.alias("common"), F.explode(F.slice("found", F.lit(1), room)).alias("x")).select("id", "common", "x.value")
    half = COORDINATES // 2
    sketch = [_packed(F.slice("signature", F.lit(k * half + 1), F.lit(half))).alias(f"s{k + 1}") for k in (0, 1)]
    return lists.join(classes.select("id", F.col("n_shingles").alias("n"), *sketch), "id").select("value", "id", "n", "s1", "s2", "common")


def _packed(coordinates: Column) -> Column:
    """The low two bits of up to 32 coordinates in one integer."""
    return F.aggregate(coordinates, F.lit(0).cast("long"), lambda x, c: F.shiftleft(x, 2).bitwiseOR(c.bitwiseAND(3)))


def _near(x: str, y: str) -> Column:
    """Whether enough coordinates of two postings agree in two bits; x and y: prefixes of their columns."""
    apart = F.lit(0)
    for k in ("s1", "s2"):
        differ = F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))
        either = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        apart = apart + F.bit_count(either)
    return apart <= COORDINATES - SKETCH_MATCHES


def _alike(x: str, y: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def matching(pairs: DataFrame, classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The distinct pairs (a, b) whose signatures agree in at least so many coordinates."""
    of = classes.select("id", "signature")
    pairs = pairs.distinct().join(of.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
    pairs = pairs.join(of.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.where(same >= matches).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs, as a written table: they are counted and then used."""
    return written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")


def sets_of(texts: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the shingle sets of the classes of a written table of ids, as a written table.

    The rows that stand for them are broadcast if a count shows that they are few, else joined.
    """
    rows = classes.join(ids, "id", "left_semi").select("id", "one.doc_id", "one.mark")
    few = ids.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(rows) if few else rows, ["doc_id", "mark"])
    return written(shingle_sets(found, words), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for ha, hb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def one_of_each(docs: DataFrame, words: int) -> DataFrame:
    """The documents of docs that are the smallest of their component, with all their columns.

    Rows with a null id stay: nothing can be held against them. Of rows of one id
    in one component one stays, as of rows of one id that are empty.
    """
    require(docs, "doc_id", "text")
    kept = linked(docs, words).where("kept").groupBy("doc_id", "mark").agg(F.first("group").alias("group"))
    # Everything of docs in one column, so that no name of its can clash.
    rows = docs.where(docs["doc_id"].isNotNull())
    rows = rows.select(whole_row(rows).alias("row"), rows["doc_id"].cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("mark"))
    first = rows.join(kept, ["doc_id", "mark"]).dropDuplicates(["doc_id", "group"])
    return first.select([F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(docs["doc_id"].isNull()))


def link_components(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    require(docs, "doc_id", "text")
    return linked(docs, words).select("doc_id", "n_shingles", "component_id", "kept")


def linked(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, n_shingles, group, component_id, kept) of every row; group is the component's key, null for empty sets."""
    signed = written(signatures(docs, words), "signatures")
    groups = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles")
    # A class is known by both hashes of its set and its size, and numbered as it is written; one row stands for it.
    classes = groups.agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    lists = written(postings(classes), "postings")
    texts = marked(docs)
    led_pairs = None
    for n in range(LEADERS):
        more = led(lists, n)
        led_pairs = more if led_pairs is None else led_pairs.unionByName(more)
    close = written(matching(led_pairs, classes), "close")
    links = written(confirmed(close, sets_of(texts, classes, ends(close), words)).distinct(), "found")
    left = written(apart(lists, components(links)), "apart")
    long = left.groupBy("value").agg(F.count("*").alias("members")).where(F.col("members") > SHORT_LIST).select("value")
    short = left.join(long, "value", "left_anti")
    rare = written(rarest_shingles(left.join(long, "value", "left_semi"), texts, classes, words), "rarest")
    pairs = across(short).unionByName(across(rare))
    close = written(matching(pairs, classes).join(close, ["a", "b"], "left_anti"), "close")
    links = links.unionByName(confirmed(close, sets_of(texts, classes, ends(close), words))).distinct()
    per = classes.join(components(links), "id", "left").select("k1", "k2", "n_shingles", "one.doc_id", F.coalesce("component", "id").alias("group"))
    least = per.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    per = per.join(least, "group").select("k1", "k2", "n_shingles", "group", "component_id")
    out = signed.where("n_shingles > 0").join(per, ["k1", "k2", "n_shingles"], "left").select("doc_id", "mark", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.unionByName(signed.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def led(lists: DataFrame, n: int) -> DataFrame:
    """Pairs of each member of a list with the list's leader: the most common one, or for other n one by a hash."""
    order = -F.col("common") if n == 0 else F.xxhash64("id", F.lit(n))
    leaders = lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), "id", "n", "s1", "s2")).alias("top"))
    tops = leaders.select("value", *[F.col(f"top.{c}").alias(f"top_{c}") for c in ("id", "n", "s1", "s2")])
    pairs = lists.join(tops, "value").where((F.col("id") != F.col("top_id")) & _alike("n", "top_n") & _near("", "top_"))
    return pairs.select(F.least("id", "top_id").alias("a"), F.greatest("id", "top_id").alias("b"))


def apart(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists (with component) whose members lie in different components."""
    placed = lists.join(found, "id", "left").select(*lists.columns, F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    return placed.join(several, "value", "left_semi")


def rarest_shingles(members: DataFrame, texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The members posted under the rarest of their shingles, with rest: how many shingles are not rarer.

    Of n shingles, ceil(0.8 n) at least are shared by any set similar enough, so
    one of the other n - ceil(0.8 n) + 1 is, whichever they are; the rarest among
    the members are taken.
    """
    sets = sets_of(texts, classes, written(members.select("id").distinct(), "ends"), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(1)[n].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), batch.column(0)[n].as_py(), np.int64)), pa.array(hashes)], ["id", "value"])

    shingles = written(sets.mapInArrow(run, "id bigint, value bigint"), "shingles")
    often = shingles.groupBy("value").agg(F.count("*").alias("k")).where("k > 1")
    # Shingles of one member alone are its rarest: they fill the prefix first.
    size = shingles.groupBy("id").agg(F.count("*").alias("size"))
    shared = shingles.join(often, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("found"))
    room = F.expr(f"int(size - (size * {PERCENT} + 99) div 100 + 1 - (size - size(found)))")
    taken = shared.join(size, "id").withColumn("room", room).where("room > 0")
    taken = taken.select("id", F.posexplode(F.slice("found", F.lit(1), F.col("room"))).alias("at", "x"), F.expr("size - size(found)").alias("alone"))
    own = members.select("id", "n", "s1", "s2", "common", "component").distinct()
    taken = taken.select("id", "x.value", (F.col("alone") + F.col("at")).alias("before")).join(own, "id")
    return taken.select(*members.columns, (F.col("n") - F.col("before")).alias("rest"))


def across(lists: DataFrame) -> DataFrame:
    """Pairs of a list's members that lie in different components, and that rest, if there, does not rule out."""
    columns = [c for c in ("id", "n", "s1", "s2", "component", "rest") if c in lists.columns]
    x, y = (lists.select("value", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "xy")
    wanted = (x["value"] == y["value"]) & (F.col("x_id") < F.col("y_id")) & (F.col("x_component") != F.col("y_component")) & _alike("x_n", "y_n") & _near("x_", "y_")
    if "rest" in columns:
        # What two sets share is no more than what follows, in both, the first they share.
        wanted = wanted & (F.least("x_rest", "y_rest") * (100 + PERCENT) >= PERCENT * (F.col("x_n") + F.col("y_n")))
    return x.join(y, wanted).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
