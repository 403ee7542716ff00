"""Token ids as Parquet list columns.

Documents are dealt by ranges of their id, sorted, encoded in Arrow batches and
written by Spark's Parquet writer: one row per document, the ids as a list
column. Writer version 2 gives delta or dictionary encoding; block and page
sizes and rows per page are set, and the page indexes let a reader take single
documents or only the counts without touching the ids.

Rows: one row per input row, in ascending id order, those of one id by a hash of
their text; rows with a null id come first. A null text is an empty text and holds the end id alone. Repeated
rows stay, and rows that tie in id and text are equal in all that is stored. Extra
columns, whatever their names, are dropped. An empty table gives an empty store.
Texts of any length are encoded whole, one list each; a long one has pages of its
own. An id with more than SAME_ID_ROWS rows is dealt to several tasks.
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.scratch import scratch_dir

from .backtrack_bpe import byte_letters
from .common import require, small_batches, whole_text

#: Texts of these characters are cut exactly as the library cuts them.
PLAIN = r"[\t-\r\x20-\x7e\xa1-ɏͰ-ͳΑ-ΡΣ-ωА-я‐-‧€]*"
#: Stands before a part that follows a line end; not a plain character.
_LINE = "\x01"
#: A run of these is a word of its own to the pre-tokenizer after a letter and before the end of a part.
SYMBOLS = string.punctuation
#: Bytes of the characters of PLAIN that are ASCII, white space but for space and line end, and pairs of these two.
_ASCII = bytes([*range(9, 14), *range(32, 127)])
_RARE = "\t\v\f\r"
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Words and parts that one worker remembers: the first ones it meets, among them all frequent ones.
REMEMBERED = 250_000
#: New words given to the library at once; more are slower by the word.
JOINED = 50
#: Bytes of text encoded at once.
TEXT_BYTES = 7 << 20
#: Rows of one id that stay in one range.
SAME_ID_ROWS = 10_000
BLOCK_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


class Encoder:
    """A tokenizers file; words that were seen before are not encoded again.

    A text of plain characters without two white spaces in a row falls apart at
    its spaces and line ends: the pre-tokenizer never joins what lies on both
    sides of the start of one. Its parts are numbered by Arrow. Those that are
    letters and then symbols fall apart into words of the pre-tokenizer. Words are
    looked up among the known ones, and the library's model encodes the new ones,
    many at a time, in its byte alphabet: the lengths of tokens tell them apart.
    Other new parts go to the library as they are, and any other text whole, as
    does a text that holds the content of an added token. literal takes special
    tokens in a text for plain characters; else they are what the library makes
    of them as loaded.
    """

    def __init__(self, content: str, literal: bool = False):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark's tasks are all the parallelism there is.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(content)
        if literal:
            self.tokenizer.encode_special_tokens = True
        file = json.loads(content)
        self.added = [x["content"] for x in file.get("added_tokens") or []]
        pre, model, letters = file.get("pre_tokenizer") or {}, file["model"], byte_letters()
        cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(file.get(x) for x in ("normalizer", "truncation", "padding"))
        # Every byte is a token, and no token is longer or shorter than what it stands for.
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and model["vocab"].keys() >= set(letters)
        self.by_part = cut and plain
        if self.by_part:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            #: The byte alphabet, with the space for a zero byte, which plain characters do not have.
            self.letters = " " + letters[1:]
            self.length = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.length[list(model["vocab"].values())] = list(map(len, model["vocab"]))
        self.plain, self.gap = regex.compile(PLAIN).fullmatch, regex.compile(r"[\t-\r\x20]{2}").search
        #: Where the ids of words and parts that were met lie; the empty one has none.
        self.known = {"": 0}
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts, one by one."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)), np.int64)

    def _falls_apart(self, text: str) -> bool:
        """Whether a text is of plain characters without two white spaces in a row; most need no regular expression for that."""
        if any(x in text for x in _PAIRS):
            return False
        others = text.encode().translate(None, _ASCII)
        if others and not self.plain(others.decode()):
            return False
        return not any(x in text for x in _RARE) or not self.gap(text)

    def _holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words of the pre-tokenizer."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        named = charmap_decode("\0".join(words).encode(), "strict", self.letters)[0].split(" ")
        ids = [self.model.encode_batch_fast([" ".join(named[at : at + JOINED])], add_special_tokens=False)[0].ids for at in range(0, len(named), JOINED)]
        flat = np.array(list(chain.from_iterable(ids)), np.uint32)
        ends, stops = np.cumsum(self.length[flat]), np.cumsum(np.array(list(map(len, named)), np.int64))
        after = np.searchsorted(ends, stops, "right")
        if after[-1] != len(flat) or not np.array_equal(ends[after - 1], stops):
            raise RuntimeError("the library cuts words otherwise")
        return flat, np.diff(after, prepend=0)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct parts; a part that starts with \\x01 follows a line end, any other a space."""
        # Each part is cut in two in place: what stands before the symbols at its end, and these.
        _, offsets, content = parts.buffers()
        at = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1]
        cut = np.repeat(at, 2)[: 2 * len(parts) + 1]
        cut[1::2] += pc.binary_length(pc.ascii_rtrim(parts, characters=SYMBOLS)).to_numpy()
        pieces = pa.StringArray.from_buffers(2 * len(parts), pa.py_buffer(cut), content).dictionary_encode()
        words = ["", "\n", *[" " + x if x.isalpha() else _word(x) for x in pieces.dictionary.to_numpy(False).tolist()]]
        stem, symbols = pieces.indices.to_numpy().reshape(-1, 2).T + 2
        # A line end or nothing, a stem, symbols or nothing; or else an entry of its own, which the library gets as it is.
        at = np.stack([pc.starts_with(parts, _LINE).to_numpy(False).astype(np.int64), stem, symbols], 1)
        rows = np.flatnonzero(~np.array(list(map(bool, words)))[stem])
        at[rows] = 0
        at[rows, 0] = len(words) + np.arange(len(rows))
        keys = words + ["\n" + x[1:] if x[:1] == _LINE else " " + x for x in parts.take(pa.array(rows)).to_numpy(False).tolist()]
        known = self.known.get
        entry = np.array([known(x, -1) for x in keys], np.int64)
        new = np.flatnonzero(entry < 0)
        start, size, flat = self.start[entry], self.size[entry], self.flat
        if len(new):
            fresh, n = [keys[i] for i in new.tolist()], int(np.searchsorted(new, len(words)))
            (ids, own), (more_ids, more) = self._words(fresh[:n]), self._library(fresh[n:])
            size[new] = own = np.concatenate([own, more])
            start[new] = len(flat) + np.cumsum(own) - own
            flat = np.concatenate([flat, ids, more_ids])
            if len(self.known) < REMEMBERED:
                self.known.update(zip(fresh, range(len(self.start), len(self.start) + len(fresh)), strict=True))
                self.start, self.size, self.flat = np.concatenate([self.start, start[new]]), np.concatenate([self.size, own]), flat
        return flat[_places(start[at.ravel()], size[at.ravel()])], size[at].sum(1)

    def encode(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after the other, each followed by end, and how many each has."""
        cut, heads = [], []
        for text in texts:
            if self.by_part and self._falls_apart(text) and not self._holds_added(text):
                cut.append(text := text.replace("\n", " " + _LINE))
                heads.append(text.partition(" ")[0])
            else:
                cut.append("")
                heads.append(text)
        parts = pc.split_pattern(pa.array(cut, pa.string()), " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.dictionary_encode()
        ids, size = self._parts(words.dictionary)
        head_ids, head_size = self._library(heads)
        tail = np.frombuffer(end, "<u4")
        # The first part of a text, or a text that is not cut, is an entry of its own, and so is the end. Entries are strings of bytes to Arrow.
        flat = np.concatenate([ids, head_ids, tail])
        entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size) + len(texts) + 1, [None, pa.py_buffer(4 * np.cumsum(np.concatenate([[0], size, head_size, [len(tail)]]))), pa.py_buffer(flat)])
        at = words.indices.to_numpy().copy()
        at[ends[:-1]] = len(size) + np.arange(len(texts))
        at = np.insert(at, ends[1:], len(entries) - 1)
        _, offsets, content = entries.take(pa.array(at)).buffers()
        stops = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends[1:] + np.arange(1, len(texts) + 1)])] // 4
        return np.frombuffer(content, np.uint32, int(stops[-1])), np.diff(stops)


def _word(piece: str) -> str:
    """The word of the pre-tokenizer that a piece of a part is, if it is one: symbols, or letters after a line end."""
    if piece[:1] == _LINE:
        return piece[1:] if piece[1:].isalpha() else ""
    return piece if piece[-1:] in SYMBOLS else ""


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of all entries, one after the other."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of the rows in order, about TEXT_BYTES of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            ids.append(some.column(0))
            texts += some.column(1).to_pylist()
            size += pc.sum(pc.binary_length(some.column(1))).as_py()
            if size >= TEXT_BYTES:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


_LOADED: dict[tuple[int, bool], Encoder] = {}


def encoder(content: str, literal: bool = False) -> Encoder:
    key = hash(content), literal
    if key not in _LOADED:
        _LOADED[key] = Encoder(content, literal)
    return _LOADED[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, literal: bool = True) -> None:
    """Encode whole texts and write (part, id, n_tokens, local_start, tokens) under path, in ascending id order.

    literal: special tokens that stand in a text are plain characters. Without it they get their ids, as the library has it when loaded.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(content.value, literal), TaskContext.get().partitionId(), 0
        for ids, texts in _gathered(batches):
            flat, n = enc.encode(texts, end)
            ends = np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), ids, pa.array(n), pa.array(start + ends[:-1]), tokens], ["part", id_col, "n_tokens", "local_start", "tokens"])
            start += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, whole_text(text_col).alias("text"))
    # Ranges are found from a sample of the ids alone, unless one id has so many rows that its range has to be split.
    usual = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > SAME_ID_ROWS).isEmpty()
    by = [F.col(id_col)] if usual else [F.col(id_col), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    encoded = small_batches(rows).sortWithinPartitions(id_col, F.xxhash64("text"), "text").mapInArrow(run, f"part int, `{id_col}` {kind}, n_tokens bigint, local_start bigint, tokens array<int>")
    (
        encoded.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", BLOCK_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("compression", "snappy")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list | None = None, id_col: str = "doc_id", with_tokens: bool = True) -> DataFrame:
    """(id, start, n_tokens[, tokens]): start counts the ids of all documents before.

    The starts need two columns of counts only; ids (a list of document ids)
    goes to the Parquet reader, which skips row groups and pages by their index.
    """
    store = spark.read.parquet(path)
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file: the running total over files is small whatever the rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = store.where(F.col(id_col).isin(ids)) if ids is not None else store
    kept = [id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens"]
    return rows.join(F.broadcast(bases), "part").select(*kept, *(["tokens"] if with_tokens else []))


def with_crc32(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Replace the list column by ids_crc32, over little-endian unsigned 32-bit ids."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return small_batches(tokens).select(id_col, "start", "n_tokens", "tokens").mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write a store into the shared folder, encoded by the library as loaded, and return what its files hold, with checksums."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id, literal=False)
    return with_crc32(read_tokens(spark, path))
