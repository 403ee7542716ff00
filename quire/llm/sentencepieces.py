"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is escaped, cut where no piece can reach across, and every part is
merged by a score-ordered agenda: a heap of adjacent symbol pairs, highest
score first, leftmost first among equals; a pair whose symbols have changed is
skipped. The parts of an Arrow batch that were not seen before are then checked
against the sentencepiece library, and any difference stops the job.

Rows: one output row per input row. A null text is an empty text, which has the
end id alone. Repeated rows are encoded like any other; extra columns are
dropped; an empty table gives an empty result. Texts of any length are encoded
whole: the agenda is O(n log n) in the length of a part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require, small_batches, whole_text

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Marks before which a text is cut, if no piece joins one to a letter before it.
MARKS = "\n.,!?;:%&$*#|"
#: Parts longer than this are encoded but not remembered.
LONG_PART = 48
#: Parts that one worker remembers: the first ones it meets, among them all frequent ones.
REMEMBERED = 250_000
#: Documents whose ids are held as arrays at once.
ROWS = 500


class Known(dict):
    """Remembered parts; one that is missing is merged."""

    def __init__(self, vocab: MergeVocabulary):
        self.learn = vocab.learn

    def __missing__(self, part: str) -> str:
        return self.learn(part)


class MergeVocabulary:
    """Pieces and scores of a merge-type model, with encode and decode."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.texts, self.bytes = {}, [], {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.texts.append(b"")
            elif lib.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
                self.unknown = i
            else:
                if not lib.is_unused(i):
                    self.pieces[piece] = (i, lib.get_score(i))
                self.texts.append(piece.replace(SPACE, " ").encode())
        if any("\n" in p for p in self.pieces) or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces of this model reach across words or lines")
        joined = {a + b for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        marks = [m for m in MARKS if not any(c + m in joined for c in string.ascii_letters)]
        # Few other letters, if any, are joined to a mark; no cut is made after them.
        bound = "".join(sorted({c for c, m in joined if m in marks}))
        #: Cuts a line between a letter and a mark.
        self.cut = re.compile(f"(?<=[^\\W\\d_{re.escape(bound)}])(?=[{re.escape(''.join(marks))}])").split
        self.has_mark = re.compile(f"[{re.escape(''.join(marks))}]").search
        self.end = lib.eos_id()
        #: Part to its ids as decimal text; odd: what a part decodes to, if not to itself.
        self.known: dict[str, str] = Known(self)
        self.odd: dict[str, str] = {}
        self.fresh: list[tuple[str, str]] = []

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda of adjacent pairs."""
        pieces = self.pieces
        symbols: list[str] = list(part)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        agenda = []
        for i in range(size - 1):
            both = symbols[i] + symbols[i + 1]
            if both in pieces:
                agenda.append((-pieces[both][1], i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i] if symbols[i] else size
            if j >= size or len(symbols[i]) + len(symbols[j]) != len(both) or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (wider := both + symbols[k]) in pieces:
                    heapq.heappush(agenda, (-pieces[wider][1], i, wider))
            if (h := before[i]) >= 0 and (wider := symbols[h] + both) in pieces:
                heapq.heappush(agenda, (-pieces[wider][1], h, wider))
        ids: list[int] = []
        for symbol in symbols:
            if symbol in pieces:
                ids.append(pieces[symbol][0])
            elif symbol and self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            elif symbol:
                ids.append(self.unknown)
        return ids

    def learn(self, part: str) -> str:
        """Ids of a part as decimal text; remembered, and kept for the next check."""
        ids = self.merge(part)
        text = " ".join(map(str, ids))
        decoded = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        if decoded != part.replace(SPACE, " "):
            self.odd[part] = decoded
        self.fresh.append((part, text))
        if len(part) <= LONG_PART and len(self.known) < REMEMBERED:
            self.known[part] = text
        return text

    def parts(self, text: str) -> list[str]:
        """The parts of a text; no piece reaches from one into the next."""
        if not text:
            return []
        out: list[str] = []
        for n, line in enumerate((SPACE + text.replace(" ", SPACE)).split("\n")):
            if n:
                out.append("\n")
            for run in self.cut(line) if self.has_mark(line) else (line,):
                if SPACE + SPACE in run or run.endswith(SPACE):
                    out += _RUNS.findall(run)
                elif run:
                    first, *rest = run.split(SPACE)
                    if first:
                        out.append(first)
                    out += [SPACE + x for x in rest]
        return out

    def ids_and_text(self, text: str) -> tuple[str, str]:
        """All ids of a text with the end id, as decimal text, and the decoded text."""
        parts, known = self.parts(text), self.known
        ids = " ".join([*[known[x] for x in parts], str(self.end)])
        if self.odd:
            parts = [self.odd.get(x, x) if x in self.odd else x.replace(SPACE, " ") for x in parts]
            decoded = "".join(parts)
        else:
            decoded = "".join(parts).replace(SPACE, " ")
        return ids, decoded[1:] if decoded.startswith(" ") else decoded

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_and_text(text)[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        decoded = b"".join(self.texts[i] for i in ids).decode("utf-8", "replace")
        return decoded[1:] if ids and decoded.startswith(" ") else decoded

    def check(self) -> None:
        """Hold the parts that are new since the last check against the library."""
        fresh, self.fresh = self.fresh, []
        spaced = [x for x in fresh if x[0][0] == SPACE]
        bare = [x for x in fresh if x[0][0] != SPACE]
        for some, ask, skip in ((spaced, lambda p: p[1:], 0), (bare, lambda p: "\n" + p, len(self.merge(SPACE + "\n")))):
            for (part, ids), expected in zip(some, self.library.encode([ask(p) for p, _ in some], num_threads=1), strict=True):
                if ids != " ".join(map(str, expected[skip:])) and part != SPACE:
                    raise RuntimeError(f"the library encodes {part[:80]!r} otherwise")
        if len(self.odd) > REMEMBERED:
            self.known.clear()
            self.odd.clear()


_LOADED: dict[bytes, MergeVocabulary] = {}


def vocabulary(model: bytes) -> MergeVocabulary:
    """The vocabulary of a model file's content, one for each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = MergeVocabulary(model)
    return _LOADED[key]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): every whole text with the end id, and back."""
    require(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [vocab.ids_and_text(x.as_py()) for x in batch.column(1)]
                vocab.check()
                ids = [np.fromstring(x, np.int32, sep=" ") for x, _ in found]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([y for _, y in found], pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, whole_text(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, without building the arrays."""
    require(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model.value)
        sha = hashlib.sha256
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                x, y = vocab.ids_and_text(text.as_py())
                n.append(x.count(" ") + 1)
                ids.append(sha(x.encode()).hexdigest())
                decoded.append(sha(y.encode()).hexdigest())
            vocab.check()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, whole_text(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
