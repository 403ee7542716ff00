"""Fill-in-the-middle: a text is cut twice and its parts put in another order.

A text is a run of units (code points, words or lines), and a unit begins where a
predicate on two adjacent characters holds. Texts are decomposed into chunks that
overlap by one byte, so that each pair of neighbours lies whole in one chunk.
Boundaries are counted in all chunks side by side; prefix sums over the chunks of
a text say how many units it has and which chunks own its two cuts; only these
chunks are scanned again for the places. No position of any other boundary is
ever held.

Cuts and form are drawn from a digest of the seed and the row's id, so that every
run agrees, and rows of one id are drawn alike.

Rows: one output row per input row. A null text is an empty text and stays plain,
as does one that holds a mark. A null id is drawn as an empty one. Repeated rows
give repeated rows, equal cuts an empty middle; extra columns, whatever their
names, are dropped; an empty table gives an empty result. Texts of any length are
cut whole: past its own bytes, a text takes memory by its chunks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, small_batches, whole_text
from .offsets import gathered, places

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, and chunks whose bytes are looked at side by side.
CHUNK = 4096
TOGETHER = 256

Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


#: Whether a unit begins at a byte, by the byte before it and the byte itself.
UNITS: dict[str, Predicate] = {
    "character": lambda before, now: (now & 0xC0) != 0x80,
    "word": lambda before, now: _space(before) & ~_space(now),
    "line": lambda before, now: before == 10,
}


class Chunks:
    """The texts of one buffer in chunks, and the number of boundaries in each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, predicate: Predicate, chunk: int = CHUNK):
        self.data, self.ends, self.predicate = data, ends, predicate
        size = np.diff(ends)
        self.of_text = -(-size // chunk)
        self.first = np.cumsum(self.of_text) - self.of_text
        nth = np.arange(int(self.of_text.sum())) - np.repeat(self.first, self.of_text)
        self.start = np.repeat(ends[:-1], self.of_text) + nth * chunk
        self.size = np.minimum(np.repeat(ends[1:], self.of_text) - self.start, chunk)
        self.head = nth == 0
        self.counts = np.zeros(len(self.start), np.int64)
        for at in range(0, len(self.start), TOGETHER):
            some = slice(at, at + TOGETHER)
            self.counts[some] = np.add.reduceat(self._marks(some)[1], np.cumsum(self.size[some]) - self.size[some], dtype=np.int64)
        self.upto = np.cumsum(self.counts)
        #: Boundaries before each text, and units in it.
        self.before = np.concatenate([[0], self.upto])[self.first]
        self.units = np.where(size > 0, np.concatenate([[0], self.upto])[self.first + self.of_text] - self.before + 1, 0)

    def _marks(self, some) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether a unit begins there) in the chosen chunks; the start of a text is no boundary."""
        start, size = self.start[some], self.size[some]
        at = places(start, size)
        mark = self.predicate(self.data[np.maximum(at - 1, 0)], self.data[at])
        mark[(np.cumsum(size) - size)[self.head[some]]] = False
        return at, mark

    def cut(self, ranks: np.ndarray) -> np.ndarray:
        """The place in the buffer of one rank for each text: where so many units end."""
        size = np.diff(self.ends)
        out = self.ends[:-1] + np.where(ranks >= self.units, size, 0)
        inner = np.flatnonzero((ranks > 0) & (ranks < self.units))
        wanted = self.before[inner] + ranks[inner]
        owner = np.searchsorted(self.upto, wanted)
        again, which = np.unique(owner, return_inverse=True)
        for at in range(0, len(again), TOGETHER):
            some = again[at : at + TOGETHER]
            where, mark = self._marks(some)
            found = where[mark]
            mine = np.flatnonzero((which >= at) & (which < at + TOGETHER))
            ahead = np.cumsum(self.counts[some]) - self.counts[some]
            own = owner[mine]
            out[inner[mine]] = found[ahead[which[mine] - at] + wanted[mine] - (self.upto[own] - self.counts[own]) - 1]
        return out


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of texts without nulls; ends starts at 0."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _draws(seed: int, id_col: str) -> Column:
    """Four numbers of 32 bits from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _check_marks(marks: tuple[str, str, str]) -> None:
    for a in marks:
        for b in marks:
            inside = a != b and a in b
            if not a or inside or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("marks must neither hold nor run into one another")
    if len(set(marks)) != 3:
        raise ValueError("marks must differ")


def fill_in_middle(docs: DataFrame, unit: str = "character", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1, marks: tuple[str, str, str] = MARKS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output): every text in the form that its id draws.

    n counts units; form is plain, psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle), and the counts of units are null where it is plain.
    """
    require(docs, id_col, text_col)
    _check_marks(marks)
    predicate = UNITS[unit]
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = batch.column(2).values.slice(batch.column(2).offset * 4).to_numpy()[: 4 * batch.num_rows].reshape(-1, 4)
            at = 0
            for key, texts in gathered([batch]):
                data, ends = _buffer(texts)
                chunks = Chunks(data, ends, predicate, chunk)
                n, h = chunks.units, draws[at : at + len(texts)]
                at += len(texts)
                ranks = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
                marked = np.any([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in marks], axis=0)
                plain = (n == 0) | marked | (h[:, 2] % 100 >= fim_percent)
                spm = h[:, 3] % 100 < spm_percent
                one, two = chunks.cut(ranks[:, 0]), chunks.cut(ranks[:, 1])
                view, out = memoryview(data), []
                for a, b, c, d, is_plain, is_spm in zip(ends[:-1].tolist(), one.tolist(), two.tolist(), ends[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                    if is_plain:
                        out.append(bytes(view[a:d]))
                    elif is_spm:
                        out.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
                    else:
                        out.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
                form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
                counts = [pa.array(x, pa.int64(), mask=plain) for x in (ranks[:, 0], ranks[:, 1] - ranks[:, 0])]
                yield pa.RecordBatch.from_arrays([key, pa.array(n), form, *counts, pa.array(out, pa.binary()).cast(pa.string())], [id_col, "n", "form", "prefix_units", "middle_units", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(id_col, whole_text(text_col).alias("text"), _draws(seed, id_col).alias("draws"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from. A mark stands once, so what lies between two of them is a part whole."""
    p, s, m = marks
    past = lambda text, mark: F.substring_index(text, mark, -1)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    middle = past(output, m)
    psm = F.concat(past(upto(output, s), p), middle, upto(past(output, s), m))
    spm = F.concat(upto(past(output, p), m), middle, past(upto(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Outputs and the texts restored from them as digests."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        id_col, "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"),
    )
