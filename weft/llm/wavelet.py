"""A wavelet matrix over a sequence of small codes, in numpy.

Level by level, from the highest bit down, the sequence's bits are packed into
64-bit words with a directory of ones before each word, and the sequence is
split stably into those with a 0 and those with a 1. A rank query follows one
code through the levels with one popcount each, for any number of places at once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << bit) - U(1)))


class WaveletMatrix:
    def __init__(self, codes: np.ndarray, width: int):
        """``codes``: unsigned 8-bit values below ``2 ** width``."""
        self.n, self.width, self.levels = len(codes), width, []
        for shift in range(width - 1, -1, -1):
            bit = (codes >> shift & 1).astype(bool)
            self.levels.append((Bits(bit), self.n - int(bit.sum())))
            codes = np.concatenate((codes[~bit], codes[bit]))

    def count(self, code: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``code`` stands in each ``[start, end)``."""
        for level, (bits, zeros) in enumerate(self.levels):
            if code >> (self.width - 1 - level) & 1:
                start, end = zeros + bits.ones(start), zeros + bits.ones(end)
            else:
                start, end = start - bits.ones(start), end - bits.ones(end)
        return end - start
