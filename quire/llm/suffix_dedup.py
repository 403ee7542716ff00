"""Repeated byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes cuts the texts into phrases: a cut stands where
the hash is the least among the reach + 1 places that some start can see before
it. Equal bytes are cut alike wherever they stand, and every start of a string of
length bytes has a first cut inside that string. The parse is the list of cuts.
A suffix of the corpus is then a suffix of a phrase followed by a suffix of the
parse, and two starts are neighbours in corpus order, with length bytes in
common, only if what stands before and after their cuts agrees. Both parts are
ordered, to a depth of length bytes, and the orders combined:

1. Cuts whose next anchor bytes stand once in the corpus repeat nothing. Cuts
   that agree in their whole context, all bytes of the strings whose cut they are,
   are one entry of the dictionary, and all their strings are repeated. This takes
   digests alone; most of a corpus ends here.
2. What is left are entries that share an anchor and differ further out. For each
   anchor the texts after its cuts are sorted: the suffix array of the parse. The
   phrases before its cuts are sorted from their ends: the suffix array of the
   dictionary. With the common lengths of neighbours in both arrays a start at
   distance d before its cut is repeated if another entry is in the same interval
   of the dictionary's array to a depth of d and of the parse's to length - d.
3. Anchors with more than GROUP entries are not brought together. Their starts are
   ranked by digests that are counted before they are shuffled: in blocks of BLOCK
   starts by the bytes that all strings of a block share, then by all bytes of the
   block, and only where blocks differ start by start.

Digests are of the bytes themselves (BLAKE2b): 64 bits for the key that positions
meet under, 128 bits for what must be equal, so no structure of a text can make
unequal strings meet, as it can with a rolling hash. The rolling hash only places
the cuts: any value of it is right.

Rows: one output row per input row. A null text is an empty text. Repeated rows
repeat each other. Extra columns are dropped; an empty table gives an empty
result. The length is 400 bytes unless the caller says otherwise, and any from
LEAST on. Nothing crosses documents, and texts are read whole. Of equal strings no
one is preferred: all of them go. A row is known by its id and a 64-bit hash of its text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, small_batches, whole_text, written
from .hashing import Polynomial, mixed

LENGTH = 400
TRIGGER = 16
#: A start sees its cut at most so many bytes ahead, or three quarters of a short length; cuts lie half of that apart on average.
REACH = 300
#: The least length that leaves enough bytes behind a cut.
LEAST = 64
#: Starts ranked together, by their distance to the cut.
BLOCK = 16
#: Entries of one anchor that are sorted in one place, about 700 bytes each.
GROUP = 16_384
#: Entries up to which all pairs are compared as they are.
PAIRS = 40
#: Bytes parsed at once.
BATCH_BYTES = 1 << 20
#: Bits of the rolling hash that are compared; the rest of a word holds a place.
_PLACE_BITS = 24
_CHUNK = 1 << 22


ENTRY = ["key", "context", "check", "doc", "mark", "place", "times"]
ENTRY_SCHEMA = "key bigint, context bigint, check bigint, doc bigint, mark bigint, place bigint, times bigint"


def digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit digest of each of the byte strings."""
    both = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    return tuple(np.frombuffer(both, np.uint64).reshape(-1, 2).T)


class Parser:
    """Cuts of texts and digests of their contexts."""

    def __init__(self, length: int = LENGTH):
        if length < LEAST:
            raise ValueError(f"strings of {length} bytes are too short; the least is {LEAST}")
        self.length, self.reach = length, min(REACH, 3 * length // 4)
        self.anchor = length - self.reach
        self.roll = Polynomial(303)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each start the place of the least rolling hash in reach, the first among equals."""
        places = len(data) - TRIGGER + 1
        starts = places - self.reach
        if starts <= 0:
            return np.zeros(0, np.int64)
        sums = self.roll.sums(data)
        rolled = mixed((sums[TRIGGER:] - sums[:-TRIGGER]) * self.roll.inverses[:places]) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)
        width, out = self.reach + 1, np.empty(starts, np.int64)
        for at in range(0, starts, _CHUNK):
            some = rolled[at : min(at + _CHUNK + self.reach, places)]
            key = some | np.arange(len(some), dtype=np.uint64)
            n = len(key) - self.reach
            # The least of each window is that of a block's end and the next block's start.
            blocks = -(-len(key) // width)
            grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
            grid[: len(key)] = key
            grid = grid.reshape(blocks, width)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[:n], ahead[self.reach : self.reach + n])
            out[at : at + n] = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + at
        return out

    def entries(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, anchor, context, check, place) of every cut; place: see places()."""
        joined = b"".join(texts)
        size = np.array([len(x) for x in texts], np.int64)
        end = np.cumsum(size)
        n = np.maximum(size - self.length + 1, 0)
        of = np.repeat(np.arange(len(texts)), n)
        if not len(of):
            none = of.astype(np.uint64)
            return of, none, none, none, of
        first = end - size
        i = np.arange(len(of)) + np.repeat(first - (np.cumsum(n) - n), n)
        cut = self.cuts(np.frombuffer(joined, np.uint8))[i]
        new = np.flatnonzero(np.concatenate([[True], (cut[1:] != cut[:-1]) | (of[1:] != of[:-1])]))
        low, high, cut, of = i[new], i[np.concatenate([new[1:] - 1, [len(i) - 1]])], cut[new], of[new]
        anchor, _ = digests(joined[c : c + self.anchor] for c in cut.tolist())
        shape = ((cut - low) << 9 | (high - low)).astype(np.int64)
        heads = shape.tobytes()
        context, check = digests(heads[8 * k : 8 * k + 8] + joined[a : b + self.length] for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)))
        return of, anchor, context, check, (low - first[of]) << 18 | shape

    def blocks(self, text: bytes, key: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, context, check, place, times) of the blocks of each entry."""
        low, cut, high = places(place)
        first, last = (cut - high) // BLOCK, (cut - low) // BLOCK
        n = last - first + 1
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        near, far = np.maximum(k * BLOCK, (cut - high)[of]), np.minimum(k * BLOCK + BLOCK - 1, (cut - low)[of])
        cut, key, times = cut[of], key[of], times[of]
        # What all strings of a block share, whichever of its starts a document has; then all that these have.
        at = cut - k * BLOCK
        heads = np.stack([key.astype(np.uint64), k.astype(np.uint64)], 1).tobytes()
        core, _ = digests(heads[16 * r : 16 * r + 16] + text[a : a - (BLOCK - 1) + self.length] for r, a in enumerate(at.tolist()))
        shapes = (near << 9 | far).astype(np.int64).tobytes()
        context, check = digests(shapes[8 * r : 8 * r + 8] + text[a : b + self.length] for r, (a, b) in enumerate(zip((cut - far).tolist(), (cut - near).tolist(), strict=True)))
        return core, context, check, (cut - far) << 18 | (far << 9) | (far - near), times

    def strings(self, text: bytes, key: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, context, check, place, times) of each start of each entry; the context is its string."""
        low, _, high = places(place)
        n = high - low + 1
        of = np.repeat(np.arange(len(n)), n)
        at = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        string, check = digests(text[a : a + self.length] for a in at.tolist())
        return string, string, check, at << 18, times[of]


def places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, cut and last start that an entry's place holds."""
    low = place >> 18
    return low, low + (place >> 9 & 511), low + (place & 511)


def parse(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, context, check, doc, mark, place, times) of every entry of the parse; the key is its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)
        for batch in batches:
            some, size, first = [], 0, 0
            texts = batch.column(2)
            for n in range(batch.num_rows + 1):
                if n == batch.num_rows or size >= BATCH_BYTES:
                    if some:
                        k, *keys, place = parser.entries(some)
                        k = pa.array(k + first)
                        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.uint64).view(np.int64)) for x in keys], batch.column(0).take(k), batch.column(1).take(k), pa.array(place), pa.array(np.ones(len(place), np.int64))], ENTRY)
                    some, size, first = [], 0, n
                if n < batch.num_rows:
                    some.append(texts[n].as_py().encode())
                    size += len(some[-1])

    return docs.mapInArrow(run, ENTRY_SCHEMA)


def _refined(docs: DataFrame, entries: DataFrame, step: str, length: int) -> DataFrame:
    """Finer entries of the same starts: step is the Parser's method that makes them from a text."""
    wanted = entries.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "place", "times")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)
        for batch in batches:
            for n in range(batch.num_rows):
                own = batch.column(3)[n].values
                key, place, times = (own.field(x).to_numpy() for x in ("key", "place", "times"))
                *keys, place, times = getattr(parser, step)(batch.column(2)[n].as_py().encode(), key.view(np.uint64), place, times)
                alike = [pa.array(np.full(len(place), batch.column(k)[n].as_py(), np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.uint64).view(np.int64)) for x in keys], *alike, pa.array(place), pa.array(times)], ENTRY)

    return docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "own").mapInArrow(run, ENTRY_SCHEMA)


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at their start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some strings: their order, and how much each has in common with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    common = np.array([0, *[_common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]])
    return np.array(order), common


def repeated_starts(phrases: list[bytes], suffixes: list[bytes], near: np.ndarray, far: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each entry of one anchor the ranges of distances to the cut whose strings another entry has too.

    phrases: what stands before the cuts, from the cut backwards, far bytes of it.
    suffixes: what follows the cuts, length - near bytes of it. An entry has the
    starts near..far before its cut.
    """
    n = len(phrases)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= PAIRS:
        for i in range(n):
            for j in range(i):
                lo = max(length - _common(suffixes[i], suffixes[j]), near[i], near[j])
                hi = min(far[i], far[j])
                if lo <= hi and (hi := min(hi, _common(phrases[i], phrases[j]))) >= lo:
                    out[i].append((int(lo), int(hi)))
                    out[j].append((int(lo), int(hi)))
        return out
    (by_phrase, before), (by_suffix, after) = _array(phrases), _array(suffixes)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        # Intervals of both arrays: a new one starts where neighbours have too little in common.
        left[by_phrase] = np.cumsum(before < d)
        right[by_suffix] = np.cumsum(after < length - d)
        own = np.flatnonzero((near <= d) & (far >= d))
        _, at, count = np.unique(left[own] * (n + 1) + right[own], return_inverse=True, return_counts=True)
        for i in own[count[at] > 1].tolist():
            if out[i] and out[i][-1][1] == d - 1:
                out[i][-1] = (out[i][-1][0], d)
            else:
                out[i].append((d, d))
    return out


def ordered(docs: DataFrame, entries: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, mark, low, high): the repeated starts of entries (key, times, doc, mark, place), a bounded number for each key."""
    wanted = entries.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "place", "times")).alias("own"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                own = batch.column(3)[n].values
                place = own.field("place").to_numpy()
                text = batch.column(2)[n].as_py().encode()
                low, cut, high = (x.tolist() for x in places(place))
                phrases = [text[a:c][::-1] for a, c in zip(low, cut, strict=True)]
                suffixes = [text[c : b + length] for c, b in zip(cut, high, strict=True)]
                alike = [pa.array(np.full(len(place), batch.column(k)[n].as_py(), np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([own.field("key"), own.field("times"), *alike, own.field("place"), pa.array(phrases, pa.binary()), pa.array(suffixes, pa.binary())], names)

    names = ["key", "times", "doc", "mark", "place", "phrase", "suffix"]
    kinds = "key bigint, times bigint, doc bigint, mark bigint, place bigint, phrase binary, suffix binary"
    rows = docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "own").mapInArrow(strings, kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks() if held is not None or batch is not None else None
            if table is None:
                return
            key = table["key"].to_numpy()
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], batch is None)) + 1
            # The last key may go on in the next batch.
            done = int(ends[-1]) if len(ends) else 0
            held = table.slice(done).combine_chunks().to_batches()[0] if done < len(key) else None
            found = [[], [], [], []]
            times, doc, mark = (table[c].to_numpy() for c in ("times", "doc", "mark"))
            low, cut, high = places(table["place"].to_numpy())
            phrase, suffix = table["phrase"][:done].to_pylist(), table["suffix"][:done].to_pylist()
            for a, b in pairwise([0, *ends.tolist()]):
                runs = repeated_starts(phrase[a:b], suffix[a:b], cut[a:b] - high[a:b], cut[a:b] - low[a:b], length)
                for i, own in zip(range(a, b), runs, strict=True):
                    if times[i] == 1:  # of the others all starts are known to be repeated
                        for lo, hi in own:
                            for x, v in zip(found, (doc[i], mark[i], cut[i] - hi, cut[i] - lo), strict=True):
                                x.append(int(v))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc", "mark", "low", "high"])

    return rows.repartition("key").sortWithinPartitions("key", "doc", "mark", "place").mapInArrow(compare, "doc bigint, mark bigint, low bigint, high bigint")


def _decided(entries: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(spans, open): the starts that are repeated for certain, and the entries to be refined.

    Entries with a key of their own share nothing; those with a context in common
    share all. What stands once among others of its key is open, and so is, once
    for each context, what it can share with. Sums over keys combine before the
    shuffle. They are written before they are joined with the entries: then both
    sides of the join are plain shuffles, and adaptive execution splits a hot key.
    """
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("context", "check") for f in (F.min, F.max)]
    keys = entries.groupBy("key").agg(F.sum("times").alias("n"), *ends).where("n > 1")
    keys = written(keys.select("key", F.expr("min_context = max_context AND min_check = max_check").alias("same")), f"{label}-keys")
    met = written(entries.join(keys, "key"), label)
    contexts = met.where("NOT same").groupBy("key", "context", "check").agg(F.sum("times").alias("times"), F.min(F.struct("doc", "mark", "place")).alias("one"))
    contexts = written(contexts, f"{label}-contexts")
    some_single = written(contexts.groupBy("key").agg(F.min("times").alias("least")).where("least = 1").select("key"), f"{label}-open")
    still_open = contexts.join(some_single, "key", "left_semi").select("key", "times", "one.*")
    several = contexts.where("times > 1").select("key", "context", "check")
    low = F.shiftright("place", 18)
    starts = ["doc", "mark", low.alias("low"), (low + F.col("place").bitwiseAND(511)).alias("high")]
    whole = met.where("same").select(*starts)
    return whole.unionByName(met.where("NOT same").join(several, ["key", "context", "check"], "left_semi").select(*starts)), still_open


def repeated_spans(docs: DataFrame, group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """(doc, mark, low, high): starts low..high of strings that also start elsewhere. docs: (doc, mark, text)."""
    by_cut, rest = _decided(parse(docs, length), "cuts")
    rest = written(rest, "rest")
    large = written(rest.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key"), "large")
    # Each part is a table of its own: what one of them deals by key does not keep adaptive execution from splitting the others.
    found = [written(by_cut, "cut-spans"), written(ordered(docs, rest.join(large, "key", "left_anti"), length), "array-spans")]
    if not large.isEmpty():
        by_block, rest = _decided(written(_refined(docs, rest.join(large, "key", "left_semi"), "blocks", length), "block-entries"), "blocks")
        by_start, _ = _decided(written(_refined(docs, rest, "strings", length), "string-entries"), "strings")
        found += [written(by_block, "block-spans"), written(by_start, "start-spans")]
    return functools.reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document.

    spans: the maximal removed byte runs, each with start and stop.
    """
    require(docs, "doc_id", "text")
    Parser(length)  # a length that is too short is refused here
    null = F.col("doc_id").isNull()
    rows = docs.select("doc_id", whole_text().alias("text"))
    # A row is known by its id and a hash of its text: rows equal in both have equal results.
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(null, "text").alias("mark"), "text", null.alias("no_id"))
    spans = repeated_spans(rows.select("doc", "mark", "text"), group, length).distinct()
    spans = spans.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            size, removed, count, sha, runs = [], [], [], [], []
            for n in range(batch.num_rows):
                text = batch.column(2)[n].as_py().encode()
                merged: list[list[int]] = []
                if (found := batch.column(4)[n]).is_valid:
                    for lo, hi in zip(found.values.field("low").to_pylist(), found.values.field("high").to_pylist(), strict=True):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi + length)
                        else:
                            merged.append([lo, hi + length])
                digest, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    digest.update(text[at:lo])
                    at = hi
                digest.update(text[at:])
                size.append(len(text))
                removed.append(sum(hi - lo for lo, hi in merged))
                count.append(len(merged))
                sha.append(digest.hexdigest())
                runs.append([{"start": lo, "stop": hi} for lo, hi in merged])
            ids = [None if no else d for d, no in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, run_kind)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = rows.join(spans, ["doc", "mark"], "left").select("doc", "mark", "text", "no_id", "found")
    return small_batches(joined).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>")
