"""Two tokenizers on the same bytes: which tokens overlap, and where both end.

Both tokenizers' tokens cover the bytes of a text. np.repeat gives each byte the
number of the token that owns it, once for A and once for B. Each distinct pair of
owners in a row is an overlap; where both owners change at once both tokens end:
there the text is cut into groups, and the two tokens that end there are linked.

Linked tokens end at the same byte, so the bytes of one are a suffix of the bytes
of the other: the id pairs that can ever be linked follow from the vocabularies
alone (some hundred thousand, whatever the corpus). Links are stored by the number
of their pair; the corpus-wide counts are one sum per pair, and their table, with
its size known beforehand, goes to all tasks for the second pass.

Rows: one output row per input row. Texts that are null or empty, or whose tokens
do not spell the text in either tokenizer, have no tokens, zeros and an empty
string. Special tokens in a text are plain text. Ties for the highest count all
count as best. Repeated rows count again; extra columns, whatever their names,
are dropped; an empty table gives an empty result. Texts of any length are taken
whole; owners are laid out for WINDOW bytes at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, small_batches, whole_text, written
from .offsets import OffsetTable, gathered
from .token_store import encoder as byte_encoder

#: Bytes whose owners are laid out at once, and bytes of text that are encoded at once.
WINDOW = 1 << 20
TEXT_BYTES = 2 << 20
#: Most pairs of a table that goes to all tasks: the vocabularies' own bound, checked before any text is read.
MOST_PAIRS = 10_000_000
NO_TOKENS = ""


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, both end): token numbers of every overlap in order, and whether both tokens end where it does.

    ends_a and ends_b are where tokens end, ascending, over the same bytes.
    """
    size = int(ends_a[-1]) if len(ends_a) else 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, size, window):
        # One byte more shows whether the window's last byte ends a token.
        hi = min(lo + window + 1, size)
        owners = []
        for ends in (ends_a, ends_b):
            first, last = np.searchsorted(ends, [lo, hi - 1], "right")
            cut = np.minimum(ends[first : last + 1], hi)
            owners.append(np.repeat(np.arange(first, last + 1, dtype=np.int32), np.diff(cut, prepend=lo)))
        a, b = owners
        ends_here = [np.append(x[1:] != x[:-1], True) for x in owners]
        if hi < size or hi == lo + window + 1:
            ends_here = [x[:-1] for x in ends_here]
        at = np.flatnonzero(ends_here[0] | ends_here[1])
        found.append((a[at], b[at], ends_here[0][at] & ends_here[1][at]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _unicode_to_byte() -> dict[str, int]:
    from .backtrack_bpe import byte_letters

    return {c: b for b, c in enumerate(byte_letters())}


class Pair:
    """A byte-level tokenizer A and a piece tokenizer B, with all pairs of ids that can end together."""

    def __init__(self, content: str, model: bytes):
        import sentencepiece

        self.a = byte_encoder(content, literal=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = self._entries_a(content), self._entries_b()
        of_a, of_b = self._by_bytes(self.bytes_a), self._by_bytes(self.bytes_b)
        pairs = [(a, b) for a, x in enumerate(self.bytes_a) for n in range(len(x)) for b in of_b.get(x[n:], ())]
        pairs += [(a, b) for b, x in enumerate(self.bytes_b) for n in range(1, len(x)) for a in of_a.get(x[n:], ())]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_a, self.pair_b = table[:, 0], table[:, 1]
        self.keys = self.pair_a << 32 | self.pair_b
        self.spelling = OffsetTable(self.bytes_a), OffsetTable(self.bytes_b)
        names = [b"%d%s" % (i, end) for entries, ends in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";"))) for end in ends for i in range(len(entries))]
        self.names = OffsetTable(names)

    @staticmethod
    def _by_bytes(entries: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, x in enumerate(entries):
            if x:
                out.setdefault(x, []).append(i)
        return out

    @staticmethod
    def _entries_a(content: str) -> list[bytes]:
        vocab, byte = json.loads(content)["model"]["vocab"], _unicode_to_byte()
        out = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            out[i] = bytes(byte[c] for c in name)
        return out

    def _entries_b(self) -> list[bytes]:
        lib, out = self.b, []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            out.append(b"" if lib.is_control(i) or lib.is_unknown(i) else bytes([int(piece[3:5], 16)]) if lib.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids, counts) of A and B, flat, and which texts are spelled by both; the others have no tokens."""
        flat_a, n_a = self.a.encode([" " + t for t in texts])
        lists = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        flat_b = np.fromiter((i for x in lists for i in x), np.int64, int(n_b.sum()))
        right = np.array([t != "" for t in texts], bool)
        ids, counts = [flat_a.astype(np.int64), flat_b], [n_a.astype(np.int64), n_b]
        want = [b" " + t.encode() for t in texts]
        for k in range(2):
            # Entries have no separator: all bytes of a text are asked for by one entry more.
            right &= [spelled == w for spelled, w in zip(_spelled(self.spelling[k], ids[k], counts[k]), want, strict=True)]
        for k in range(2):
            ids[k], counts[k] = ids[k][np.repeat(right, counts[k])], np.where(right, counts[k], 0)
        return ids, counts, right

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[memoryview]]:
        """(n_a, n_b, n_groups, pair numbers of all links, group strings): flat over the texts, which are cut apart by the counts."""
        (a, b), (n_a, n_b), right = self.encode(texts)
        size_a, size_b = self.spelling[0].size[a], self.spelling[1].size[b]
        own_a, own_b, both = overlaps(np.cumsum(size_a), np.cumsum(size_b))
        last_a, last_b = own_a[both], own_b[both]
        key = a[last_a] << 32 | b[last_b]
        links = np.searchsorted(self.keys, key)
        if len(key) and (links.max() >= len(self.keys) or (self.keys[links] != key).any()):
            raise RuntimeError("linked tokens are no suffixes of one another")
        # Texts end where both tokens end, so no group reaches from one into the next.
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        ends = np.concatenate([[0], np.cumsum(n_a)])
        n_groups = np.diff(np.searchsorted(last_a, ends))
        in_a, in_b = np.bincount(group_a, minlength=len(last_a)), np.bincount(group_b, minlength=len(last_b))
        order = np.empty(len(a) + len(b), np.int64)
        is_last_a, is_last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        is_last_a[last_a], is_last_b[last_b] = 1, 1
        entries_a, entries_b = len(self.bytes_a), len(self.bytes_b)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + is_last_a * entries_a
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * entries_a + b + is_last_b * entries_b
        return n_a, n_b, n_groups, links.astype(np.int32), self.names.joined(order, n_a + n_b)


def _spelled(table: OffsetTable, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
    return table.joined(ids, counts, separator=0)


@lru_cache(maxsize=2)
def pair_of(content: str, model: bytes) -> Pair:
    """One for each Python worker."""
    return Pair(content, model)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, links array<int>, groups string): both encodings of every whole text, aligned.

    links holds the number of each link's id pair, in order; link_pairs() has the ids.
    groups has the ids, as `a1,a2|b1;a3|b2,b3`.
    """
    return _aligned(docs, byte_path, piece_path, id_col, text_col, lambda groups: str(groups, "ascii")).withColumnRenamed("named", "groups")


def _aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, name) -> DataFrame:
    require(docs, id_col, text_col)
    files = docs.sparkSession.sparkContext.broadcast(_files(byte_path, piece_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*files.value)
        for key, texts in gathered(batches, TEXT_BYTES):
            n_a, n_b, n_groups, links, groups = pair.align(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)), pa.array(links))
            named = pa.array([name(g) if n else NO_TOKENS for g, n in zip(groups, n_a.tolist(), strict=True)], pa.string())
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([key, pa.array(n_a), pa.array(n_b), pa.array(n_groups), lists, named], [id_col, "n_a", "n_b", "n_groups", "links", "named"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(id_col, whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, links array<int>, named string")


def _files(byte_path: str, piece_path: str) -> tuple[str, bytes]:
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        return f.read(), g.read()


def link_pairs(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(link, a, b): the id pair of each link number. It follows from the vocabularies alone."""
    pair = pair_of(*_files(byte_path, piece_path))
    table = pa.table({"link": np.arange(len(pair.keys), dtype=np.int32), "a": pair.pair_a, "b": pair.pair_b})
    return docs.sparkSession.createDataFrame(table)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, n): how many links of the corpus hold each pair. Added up before the shuffle; at most one row a pair and task goes through it."""
    return aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def with_counts(aligned: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds n_links, n_best and count_sum, by the counts of all links of aligned, which is read twice."""
    spark = aligned.sparkSession
    pair = pair_of(*_files(byte_path, piece_path))
    if len(pair.keys) > MOST_PAIRS:
        raise ValueError(f"{len(pair.keys)} pairs of these vocabularies can be linked, more than a table for all tasks may hold")
    # At most one row for each pair of the vocabularies, whatever the corpus.
    found = pair_counts(aligned).toArrow()
    count = np.zeros(len(pair.keys), np.int64)
    count[found.column("link").to_numpy()] = found.column("n").to_numpy()
    top = np.zeros(len(pair.bytes_b), np.int64)
    np.maximum.at(top, pair.pair_b, count)
    sent = spark.sparkContext.broadcast((count, count == top[pair.pair_b]))
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            lists = batch.column(len(kept))
            ends = lists.offsets.to_numpy().astype(np.int64)
            own = lists.values.to_numpy()[ends[0] : ends[-1]]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[own])])[ends - ends[0]]) for x in (counts, best.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.diff(ends)), pa.array(sums[1]), pa.array(sums[0])], [*kept, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return aligned.select(*kept, "links").mapInArrow(run, f"{schema}, n_links bigint, n_best bigint, count_sum bigint")


def digest_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum): texts are encoded once, into a scratch table of links."""
    rows = _aligned(docs, byte_path, piece_path, id_col, text_col, lambda groups: hashlib.sha256(groups).hexdigest())
    return with_counts(written(rows.withColumnRenamed("named", "groups_sha256"), "aligned"), byte_path, piece_path, id_col)
