"""Token ids of whole texts by the ``tokenizers`` library, encoding each distinct unit once.

A byte-level BPE tokenizer first cuts a text by a pattern whose pieces never
run from a non-space into a following space. A text may therefore be cut before
any space or newline that follows a non-space, and the ids of the parts joined;
parts joined at such places encode to the joined ids. Texts repeat such units
("` the`") far more often than they bring new ones, so each chunk's new units
are joined into blocks, encoded, cut apart by the byte lengths of the tokens,
and copied to wherever they occur.
"""

from __future__ import annotations

import os

import numpy as np

from weft.llm.textops import WordHasher


def ragged(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[start:start+n]`` one after the other, and their offsets."""
    at = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(start - at[:-1], n) + np.arange(at[-1])], at


class UnitEncoder:
    """Encodes chunks of texts (bytes and offsets, see ``text_chunks``).

    ``tokenizer`` is the path of a byte-level BPE file. Special tokens written
    out in a text are ordinary text. ``cache`` bounds the units kept between
    chunks; a full cache is emptied.
    """

    BLOCK = 8192  # bytes of joined units a call gets

    def __init__(self, tokenizer: str, cache: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is Spark's to share out
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.encode_special_tokens = True
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)  # bytes of each token: one letter stands for one byte
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token)
        self.limit = cache
        self._forget()
        self.hasher = WordHasher()
        # byte kinds: 1 printable ASCII, 2 beyond ASCII, 4 space or newline, 8 ASCII letter, 16 stop or comma
        self.kind = np.zeros(256, np.uint8)
        self.kind[0x21:0x7F] |= 1
        self.kind[0x80:] |= 2
        self.kind[[0x20, 0x0A]] |= 4
        self.kind[[*range(65, 91), *range(97, 123)]] |= 8
        self.kind[[0x2C, 0x2E]] |= 16

    def _forget(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if len(self.width) <= 65536 else np.uint32)

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Unit starts: document starts; a space or newline after printable ASCII
        or after a letter of the Latin-1 block (two bytes, the first C3); and a
        full stop or comma after an ASCII letter, where a piece ends too."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            kind = self.kind[data]
            prev = kind & 1 > 0
            prev[1:] |= (kind[1:] & 2 > 0) & (data[:-1] == 0xC3)
            cut[1:-1] = prev[:-1] & (kind[1:] & 4 > 0) | (kind[:-1] & 8 > 0) & (kind[1:] & 16 > 0)
        cut[offs] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def _ends_solid(self, data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the text before each byte position ends in a sure non-space."""
        last = data[end - 1]
        return (self.kind[last] & 1 > 0) | (last >= 0x80) & (end > 1) & (data[np.maximum(end - 2, 0)] == 0xC3)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new units and keep their ids."""
        joins = ((data[starts] == 0x20) | (data[starts] == 0x0A)) & self._ends_solid(data, ends)
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        n_joined = int(joins.sum())
        starts, ends, hashes = starts[order], ends[order], hashes[order]
        text, at = ragged(data, starts, ends - starts)
        raw = text.tobytes()
        edge = np.searchsorted(at[:n_joined], np.arange(0, at[n_joined], self.BLOCK)) if n_joined else np.zeros(0, np.int64)
        edge = np.unique(np.concatenate((edge, np.arange(n_joined, len(starts)), [len(starts)])))
        blocks = [raw[at[a]:at[b]].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        ids = [np.array(e.ids, self.flat.dtype) for i in range(0, len(blocks), 64)
               for e in self.tok.encode_batch_fast(blocks[i:i + 64], add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else self.flat[:0]
        # a unit's ids end where their bytes do
        place = np.searchsorted(np.concatenate(([0], np.cumsum(self.width[ids]))), at)
        base = len(self.flat)
        self.flat = np.concatenate((self.flat, ids))
        self.hash = np.concatenate((self.hash, hashes))
        self.start = np.concatenate((self.start, base + place[:-1]))
        self.size = np.concatenate((self.size, np.diff(place)))
        order = np.argsort(self.hash)
        self.hash, self.start, self.size = self.hash[order], self.start[order], self.size[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, id offsets by text)."""
        starts = self._cuts(data, offs)
        if not len(starts):
            return self.flat[:0], np.zeros(len(offs), np.int64)
        ends = np.concatenate((starts[1:], [len(data)]))
        h = self.hasher.hashes(data, starts, ends)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) > self.limit:
            self._forget()
        at = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.hash):
            new = self.hash[np.minimum(at, len(self.hash) - 1)] != uniq
        if new.any():
            some = first[new]
            self._learn(data, starts[some], ends[some], uniq[new])
            at = np.searchsorted(self.hash, uniq)
        which = at[inv]
        ids, total = ragged(self.flat, self.start[which], self.size[which])
        return ids, total[np.searchsorted(starts, offs)]
