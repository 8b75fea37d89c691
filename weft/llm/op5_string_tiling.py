"""Benchmark decontamination by greedy string tiling (operator 5).

Documents and benchmark items are sequences of lower-cased words, stripped of
punctuation at both ends. Seeds are windows of ``min_match`` words, hashed by a
running Karp-Rabin hash; a document is looked at only where a seed of an item
occurs in it. Seeds that lie on one diagonal of a (document, item) pair join to
maximal common runs. Greedy string tiling then marks the longest run whose words
are unmarked on both sides, cuts what overlaps it, and repeats until no run of
``min_match`` words is left. An item is leaked where the marked words cover at
least ``coverage`` of it: the tiles may stand in any order and far apart, so a
reordered passage counts like a literal one.

The benchmark is the query set: tasks cut it by hash into blocks of about
``block_bytes`` of text and write each block's sorted seeds as a file, which the
document tasks map. One pass over the documents, without a shuffle, holds every
chunk of texts against every block, one block after the other. The driver and
the plan hold no item and no block, whatever the benchmark's size; a task holds
the last ``CACHED`` blocks.

Edge cases: an item with fewer than ``min_match`` words can't be found; null or
empty texts have no words; equal items are found each for itself; among equally
long runs the first in the document goes first, then the first in the item;
repeated rows get the same answer; empty tables give no rows (documents) or no
leaks (benchmark).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.textops import WordHasher, mix, text_chunks

U = np.uint64
MIN_MATCH, COVERAGE, BLOCK_BYTES = 5, 0.6, 8 << 20
TABLE = (1 << 22) - 1
BASE = U(0xD1342543DE82EF95)  # of the running hash over words; odd, so it has an inverse
CACHED = 4                    # blocks a task keeps open
HITS = 4_000_000              # seed hits of one document expanded at once


class Words(WordHasher):
    """Word hashes without punctuation at the ends of a word."""

    def __init__(self):
        super().__init__(lower=True)
        self.soft = np.zeros(256, bool)
        self.soft[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words, word offsets); words of punctuation alone are left out."""
        starts, ends, at = self.words(data, offs)
        if not len(starts):
            return np.zeros(0, U), at
        hard = np.concatenate(([0], np.cumsum(~self.soft[data])))
        some = hard[ends] > hard[starts]
        place = np.flatnonzero(~self.soft[data])
        first, last = starts.copy(), ends.copy()
        first[some] = place[hard[starts[some]]]
        last[some] = place[hard[ends[some]] - 1] + 1
        return self.hashes(data, first[some], last[some]), np.concatenate(([0], np.cumsum(some)))[at]


def running(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the k-word windows inside documents, and their first words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    roll = np.zeros(n, U)
    for i in range(k):
        roll = roll * BASE + h[i:n + i]  # Horner's rule over the window, for all windows at once
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(roll[first]), first


def tile(runs: list[tuple[int, int, int]], n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length) of the tiles chosen."""
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    in_item, in_text, out = np.zeros(n_item, bool), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [not in_item[j + x] and i + x not in in_text for x in range(n)]
        if all(free):
            out.append((i, j, n))
            in_item[j:j + n] = True
            in_text.update(range(i, i + n))
            continue
        x = 0
        while x < n:
            y = x
            while y < n and free[y]:
                y += 1
            if y - x >= min_match:
                heapq.heappush(heap, (x - y, i + x, j + x))
            x = y + 1
    return out


class Block:
    """A block of benchmark items: word offsets, and seeds sorted by hash."""

    def __init__(self, items: list[tuple], min_match: int):
        self.k, self.ids = min_match, [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        h, self.at = Words().tokens(data, offs)
        g, first = running(h, self.at, min_match)
        order = np.argsort(g, kind="stable")
        self.seed, self.place = g[order], first[order]
        self._derive()

    def _derive(self) -> None:
        self.item = np.searchsorted(self.at, self.place, "right") - 1
        self.size = np.diff(self.at)

    def write(self, uri: str) -> dict:
        """Write the arrays as one file; what :meth:`read` needs to know of it."""
        ids = np.array([(i is None, i or 0) for i in self.ids], "<i8").reshape(-1, 2)
        scratch.write_bytes(uri, ids, self.at.astype("<i8"), self.seed.astype("<u8"), self.place.astype("<i8"))
        return {"uri": uri, "n_items": len(self.ids), "n_seeds": len(self.seed)}

    @classmethod
    def read(cls, m: dict, min_match: int) -> "Block":
        b, n, k = cls.__new__(cls), m["n_items"], m["n_seeds"]
        ids = scratch.map_array(m["uri"], "<i8", 2 * n, 0).reshape(-1, 2)
        b.k, b.ids = min_match, [None if none else int(i) for none, i in ids]
        b.at = np.asarray(scratch.map_array(m["uri"], "<i8", n + 1, 16 * n))
        b.seed = scratch.map_array(m["uri"], "<u8", k, 24 * n + 8)
        b.place = scratch.map_array(m["uri"], "<i8", k, 24 * n + 8 + 8 * k)
        b._derive()
        return b

    def table(self) -> np.ndarray:
        t = np.zeros(TABLE + 1, bool)
        t[self.seed & U(TABLE)] = True
        return t

    def runs(self, g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal runs (item, start in text, start in item, words) of one text's windows that may be seeds."""
        lo, hi = np.searchsorted(self.seed, g, "left"), np.searchsorted(self.seed, g, "right")
        n = hi - lo
        parts, a = [], 0
        total = np.concatenate(([0], np.cumsum(n)))
        while a < len(n):  # long repetitive texts: a part of the hits at a time
            b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
            m = n[a:b]
            s = np.repeat(lo[a:b] - (total[a:b] - total[a]), m) + np.arange(total[b] - total[a])
            i, j, item = np.repeat(first[a:b], m), self.place[s], self.item[s]
            order = np.lexsort((i, i - j, item))
            i, j, item = i[order], j[order], item[order]
            new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(item) != 0))) if len(i) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            parts.append((item[at], i[at], j[at], np.diff(np.append(at, len(i)))))
            a = b
        item, i, j, c = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        if len(parts) > 1:  # join runs that were cut between parts
            order = np.lexsort((i, i - j, item))
            item, i, j, c = item[order], i[order], j[order], c[order]
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + c[:-1])))
            at = np.flatnonzero(new)
            item, i, j, c = item[at], i[at], j[at], np.add.reduceat(c, at)
        return item, i, j - self.at[item], c + self.k - 1

    def leaks(self, h: np.ndarray, at: np.ndarray, maybe: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list]]:
        """(text, item, tiles) of the pairs whose tiles cover enough of the item."""
        g, first = running(h, at, self.k)
        hit = np.flatnonzero(maybe[g & U(TABLE)])
        hit = hit[np.isin(g[hit], self.seed)] if len(hit) else hit
        doc = np.searchsorted(at, first[hit], "right") - 1
        edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
        for a, b in zip(edge, [*edge[1:], len(doc)]):
            d = int(doc[a])
            item, i, j, n = self.runs(g[hit[a:b]], first[hit[a:b]])
            order = np.argsort(item, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(item[order]) != 0)))
            for x, y in zip(cut, [*cut[1:], len(order)]):
                own = order[x:y]
                t = int(item[own[0]])
                need = math.ceil(coverage * self.size[t] - 1e-9)
                if n[own].sum() < need:  # even all runs together are too few
                    continue
                tiles = tile(list(zip((i[own] - at[d]).tolist(), j[own].tolist(), n[own].tolist())), int(self.size[t]), self.k)
                if sum(z for *_, z in tiles) >= need:
                    yield d, t, tiles


MANIFEST = pa.schema([("uri", pa.string()), ("n_items", pa.int64()), ("n_seeds", pa.int64())])


def write_blocks(benchmark: DataFrame, min_match: int, block_bytes: int) -> str:
    """The items (item_id, text) in block files of about ``block_bytes`` of text; the folder of their manifest."""
    folder = scratch.new_folder(benchmark.sparkSession, "benchmark")
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def done() -> pa.RecordBatch:
            uri = f"{folder}/{scratch.attempt_name('block', number)}"
            return pa.RecordBatch.from_pylist([Block(held, min_match).write(uri)], schema=MANIFEST)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((i, t))
                size += len(t)
                if size >= 2 * block_bytes:
                    yield done()
                    held, size, number = [], 0, number + 1
        if held:
            yield done()

    n = max(1, math.ceil(total / block_bytes))
    dealt = rows.repartition(n, F.xxhash64("item_id", "text")).sortWithinPartitions("item_id", "text")
    scratch.stored(dealt.mapInArrow(write, "uri string, n_items long, n_seeds long"), f"{folder}/manifest")
    return folder


class Benchmark:
    """The blocks, as a task goes through them."""

    def __init__(self, folder: str, min_match: int):
        self.k, self.words, self.held = min_match, Words(), {}
        self.manifest = [m for m in scratch.rows_of(f"{folder}/manifest") if m["n_seeds"]]

    def _block(self, i: int) -> tuple[Block, np.ndarray]:
        if i not in self.held:
            if len(self.held) >= CACHED:
                self.held.pop(next(iter(self.held)))
            block = Block.read(self.manifest[i], self.k)
            self.held[i] = (block, block.table())
        return self.held[i]

    def leaks(self, data: np.ndarray, offs: np.ndarray, coverage: float) -> Iterator[tuple[int, Block, int, list]]:
        """(text, block, item, tiles) of a chunk of texts."""
        tokens = self.words.tokens(data, offs)
        for i in range(len(self.manifest)):
            block, maybe = self._block(i)
            for d, t, tiles in block.leaks(*tokens, maybe, coverage):
                yield d, block, t, tiles


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()),
                   ("n_tiles", pa.int64()), ("tiles", pa.string())])


def leaked(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item it leaks, with the tiles (word in text:word in item:words)."""
    folder = write_blocks(benchmark, min_match, block_bytes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Benchmark(folder, min_match)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                found = [dict(doc_id=part.column(0)[d].as_py(), item_id=block.ids[t], item_words=int(block.size[t]),
                              covered_words=sum(n for *_, n in tiles), n_tiles=len(tiles), tiles=",".join(f"{i}:{j}:{n}" for i, j, n in sorted(tiles)))
                         for d, block, t, tiles in items.leaks(data, offs, coverage)]
                yield pa.RecordBatch.from_pylist(found, schema=LEAKS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, tiles string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    folder = write_blocks(benchmark, min_match, block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Benchmark(folder, min_match)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[d for d, *_ in items.leaks(data, offs, coverage)]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents against the whole benchmark."""
    return leaked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")) \
        .withColumn("coverage", F.col("covered_words") / F.col("item_words"))
