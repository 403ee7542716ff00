"""Byte strings by number: one buffer, one table of offsets, gathered in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is on its own.
TEXT_BYTES = 4 << 20
#: Numbers that are turned into bytes at once.
BLOCK = 1 << 18


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of all entries, one after the other."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def gathered(batches: Iterator[pa.RecordBatch], most: int = TEXT_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(first column, texts) of the rows in order, by about so many bytes of text."""
    for batch in batches:
        key, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield key.slice(at, stop - at), texts.slice(at, stop - at)
            at = stop


class OffsetTable:
    """Entries of bytes; those that end with a separator lose it at the end of a text."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.start = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray, counts: np.ndarray, separator: int = 1) -> list[memoryview]:
        """The entries of so many numbers for each text, without the last bytes of separator."""
        size = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(ends[-1]), np.uint8)
        for at in range(0, len(numbers), BLOCK):
            some = numbers[at : at + BLOCK]
            out[ends[at] : ends[min(at + BLOCK, len(numbers))]] = self.data[places(self.start[some], size[at : at + BLOCK])]
        cut = ends[np.concatenate([[0], np.cumsum(counts)])]
        view = memoryview(out)
        return [view[a : max(a, b - separator)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
