"""Words and hashes of whole Arrow batches of texts, without a Python loop per word.

A batch's texts lie in one byte array with document offsets. Words are the
runs of bytes outside ``20 09-0D`` (the contract's ``[^\\x20\\x09-\\x0D]+``;
UTF-8 continuation bytes are never in that set). A word's 64-bit hash is a
polynomial over random byte values modulo 2^64, taken from prefix sums, with
a final mix, so its cost is a few vector operations per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
STEP = U(0x9E3779B97F4A7C15 | 5)  # = 5 modulo 8: powers differ early in their low bits
CHUNK = 1 << 20                 # bytes of text handled at once (one text is never cut)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit values (a bijection)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash of a sequence of equally long hash arrays (order matters)."""
    out = np.full(len(parts[0]), U(0x51ED270B ^ (seed * 0x9E3779B1 & 0xFFFFFFFF) ^ len(parts)), U)
    for p in parts:
        out = mix(out * U(0xFF51AFD7ED558CCD) + p)
    return out


def text_chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets) of slices of about ``limit`` bytes; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text))
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        part = batch.slice(at, end - at)
        flat = pc.fill_null(part.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
        data = _bytes(flat)
        offs = size[at:end + 1] - size[at]
        yield part, data, offs
        at = end


def _bytes(flat: pa.LargeStringArray) -> np.ndarray:
    offs = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    if not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8)
    return np.frombuffer(flat.buffers()[2], np.uint8)[offs[0]:offs[-1]]


class WordHasher:
    """Splits and hashes; made once per task (its power tables grow to the largest chunk)."""

    def __init__(self, lower: bool = False):
        rng = np.random.default_rng(20240607)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.inverse = U(pow(int(STEP), -1, 1 << 64))
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 18)
            self.up = np.cumprod(np.concatenate(([U(1)], np.full(n - 1, STEP, U))), dtype=U)
            self.down = np.cumprod(np.concatenate(([U(1)], np.full(n - 1, self.inverse, U))), dtype=U)

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, words before each document and in all) of a chunk."""
        word = ~self.space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offs[(offs > 0) & (offs < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offs)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans."""
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.value[data] * self.up[:len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(U))


def windows(h: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside documents, and each one's first word.

    ``at`` is the word offset array of :meth:`WordHasher.words`."""
    n = np.diff(at)
    count = np.maximum(n - k + 1, 0)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return combine([h[first + i] for i in range(k)], seed), first
