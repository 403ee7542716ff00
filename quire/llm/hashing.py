"""Vectorised hashing of bytes: polynomials modulo 2**64 over a random byte table.

The hash of bytes [a, b) is (S[b] - S[a]) * B**-a, where S is the running sum of
T[c[i]] * B**i: one pass over a buffer gives the hash of any stretch of it.
Callers that need certainty keep two of them, from different tables and bases.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Polynomial:
    """Hashes of stretches of byte buffers up to a length that grows as needed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers, self.inverses = self._upto(self.base, 1 << 12), self._upto(self.inverse, 1 << 12)

    @staticmethod
    def _upto(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        """S for a buffer of uint8."""
        if len(self.powers) <= len(data):
            self.powers, self.inverses = self._upto(self.base, len(data) + 1), self._upto(self.inverse, len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverses[start]
