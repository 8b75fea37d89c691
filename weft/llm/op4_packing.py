"""Packing of token pieces into fixed-length sequences (operator 4).

Piece lengths are whole numbers up to ``capacity``, so a packing instance is a
histogram of at most ``capacity`` counts whatever the number of documents. The
instance is solved on that histogram (driver, bounded by ``capacity``), giving
*patterns*: a run-length list of lengths that share a sequence, and how many
sequences use it. Spark makes the pieces, counts the lengths, and deals the
pieces of each length out to the places the patterns leave for that length.

The solver is the Martello-Toth reduction procedure, applied to whole runs of
equal items at a time. For the largest item j with free space g:

* nothing fits beside j: {j} is fixed;
* the largest item k that fits fills g, or no set of two or more items that
  fits has a larger sum than k: {j, k} dominates every other set with j;
* no three items fit, and the pair of the largest item k and the largest b that
  fits beside it dominates every other pair piece by piece: {j, k, b} is fixed.

What is fixed leaves the instance, which is then reduced again. When no rule
holds for the largest item, the rules are tried for the next ones; the rest is
packed best-fit decreasing, by runs over open sequences grouped by free space.

Edge cases: a null or empty text is one piece (the end id); a null doc_id is
carried along; repeated rows are packed like any others (equal pieces are
interchangeable); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import scratch
from weft.llm.bpe import UnitEncoder
from weft.llm.textops import text_chunks

CAPACITY = 1024
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, int], ...]  # ((length, copies), ...) in order of place


# --- pieces -----------------------------------------------------------------

def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``;
    the first piece takes what is over."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = UnitEncoder(tokenizer)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                ids, at = enc.encode(data, offs)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                first = at[:-1][doc] + start
                raw = ids.tobytes()
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * a:4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist())]
                yield scratch.arrow_batch(PIECES, doc_id=part.column(0).take(pa.array(doc)), piece=piece.astype(np.int32),
                                          start=start, length=length, ids_crc32=np.array(crc, np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, PIECES_DDL)


# --- the instance -------------------------------------------------------------

class Histogram:
    """Counts by length, with the few questions the reduction asks."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for size, c in counts.items():
            self.n[size] += c

    def largest(self, most: int, skip: int = 0) -> int:
        """Largest length up to ``most`` with an item left, when one of ``skip`` is taken; 0 if none."""
        for s in range(min(most, len(self.n) - 1), 0, -1):
            if self.n[s] - (s == skip) > 0:
                return s
        return 0

    def smallest(self, k: int, skip: int) -> list[int]:
        """The k smallest items left (fewer if there are no more)."""
        out: list[int] = []
        for s, c in enumerate(self.n):
            out += [s] * min(k - len(out), c - (s == skip))
            if len(out) == k:
                break
        return out

    def sums(self, g: int, skip: int) -> tuple[int, int]:
        """Bit sets of the sums up to g of (one item or none, two or more items)."""
        full = (1 << (g + 1)) - 1
        none, one, more = 1, 0, 0
        for s in range(1, g + 1):
            for _ in range(min(self.n[s] - (s == skip), g // s)):
                grown = more | ((one | more) << s) & full
                one, new_more = one | (none << s) & full, grown
                if new_more == more and _ > 1:
                    break
                more = new_more
        return one, more


def _best_pair(h: Histogram, g: int, j: int) -> tuple[int, int] | None:
    """{largest that fits, largest beside it} if it dominates all pairs item by item."""
    k = h.largest(g, j)
    left = h.n[k]
    h.n[k] -= 1
    b = h.largest(g - k, j)
    h.n[k] = left
    if not b:
        return None
    b, k = min(b, k), max(b, k)
    # the largest possible second item of any pair
    for y in range(g // 2, b, -1):
        own = h.n[y] - (y == j)
        if own >= 2 or own == 1 and any(h.n[x] - (x == j) > 0 for x in range(y + 1, g - y + 1)):
            return None
    return k, b


def reduce_instance(h: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Take fixed sets out of ``h`` until no rule applies; returns them with their counts."""
    fixed: list[tuple[Pattern, int]] = []

    def take(items: list[int]) -> None:
        need = {s: items.count(s) for s in items}
        times = min(h.n[s] // c for s, c in need.items())
        for s, c in need.items():
            h.n[s] -= c * times
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))

    again = True
    while again:
        again = False
        j = h.largest(capacity)
        while j:
            if h.n[j]:
                g = capacity - j
                k = h.largest(g, j)
                if not k:
                    take([j])
                    again = True
                    continue
                small = h.smallest(3, j)
                two = sum(small[:2]) if len(small) > 1 else capacity + 1
                three = sum(small) if len(small) > 2 else capacity + 1
                if k == g or two > g or h.sums(g, j)[1].bit_length() - 1 <= k:
                    take([j, k])
                    again = True
                    continue
                if three > g and (pair := _best_pair(h, g, j)):
                    take([j, *pair])
                    again = True
                    continue
            j -= 1
    return fixed


def best_fit(h: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over runs of equal items and of equal open sequences."""
    free: dict[int, list[tuple[Pattern, int]]] = {}
    keys: list[int] = []  # free spaces that occur, ascending

    def put(space: int, pattern: Pattern, times: int) -> None:
        if space not in free:
            free[space] = []
            keys.insert(bisect_right(keys, space), space)
        free[space].append((pattern, times))

    for s in range(capacity, 0, -1):
        while h.n[s]:
            i = bisect_right(keys, s - 1)
            if i < len(keys):
                space = keys[i]
                pattern, times = free[space].pop()
                if not free[space]:
                    del free[space], keys[i]
                copies = min(space // s, h.n[s])
                used = min(times, h.n[s] // copies)
                if used < times:
                    put(space, pattern, times - used)
                h.n[s] -= used * copies
                put(space - copies * s, (*pattern, (s, copies)), used)
            else:
                copies = min(capacity // s, h.n[s])
                used = h.n[s] // copies
                h.n[s] -= used * copies
                put(capacity - copies * s, ((s, copies),), used)
    return [x for space in keys for x in free[space]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers for a length histogram."""
    h = Histogram(counts, capacity)
    return reduce_instance(h, capacity) + best_fit(h, capacity)


# --- dealing pieces out -------------------------------------------------------

def _places(plan: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies, first sequence, offset) in rank order."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    seq = 0
    for pattern, times in plan:
        at = 0
        for s, copies in pattern:
            rows.setdefault(s, []).append((ranks.get(s, 0), copies, seq, at))
            ranks[s] = ranks.get(s, 0) + copies * times
            at += s * copies
        seq += times
    return {s: np.array(r, np.int64) for s, r in rows.items()}


def assign(pieces: DataFrame, plan: list[tuple[Pattern, int]], folder: str, per_bucket: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: the r-th piece of a length takes the r-th place.

    Ranks come from counts by (length, hash bucket), so no window holds more
    than about ``per_bucket`` pieces however common a length is."""
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(1, total // per_bucket)
    key = ["length", "bucket"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = counts.select(*key, F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = rows.withColumn("rank", F.row_number().over(inner) - 1).join(before, key).withColumn("rank", F.col("rank") + F.col("before"))
    places = _places(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                own = np.flatnonzero(length == s)
                p = places[s][np.searchsorted(places[s][:, 0], rank[own], "right") - 1]
                d = rank[own] - p[:, 0]
                seq[own], off[own] = p[:, 2] + d // p[:, 1], p[:, 3] + d % p[:, 1] * s
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in PIECES.names]
                                             + [pa.array(seq), pa.array(off)], schema=out)

    return ranked.select(*PIECES.names, "rank").mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and place in it."""
    folder = scratch.new_folder(docs.sparkSession, "packing")
    pieces = scratch.stored(cut_pieces(docs, tokenizer, end_id, capacity), f"{folder}/pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return assign(pieces, solve(counts, capacity), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: pack the whole table."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
