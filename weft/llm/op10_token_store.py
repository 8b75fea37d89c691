"""Token-id files with a minimal perfect hash index (operator 10).

Layout of a store, one triple of files per shard (a contiguous range of keys):

``*.ids``   the ids of the shard's documents in ascending key order, raw little
            endian, two bytes each if every id of the tokenizer fits, else four;
``*.docs``  int64 columns key, null flag, first id, in file order (for scans);
``*.mph``   the index: per bucket a displacement (int32), per slot a 32-bit
            fingerprint, the first id (uint64) and the number of ids (uint32).

The index holds no keys. A lookup hashes the key to a bucket, its displacement
gives the slot, and the stored fingerprint refuses a key that is not there (a
stranger passes with probability 2^-32). Every key has exactly one slot and
slots = keys, so an entry costs 16 bytes plus one displacement per
``BUCKET`` keys, and a read is two array accesses and one payload range.

Edge cases: a null text is an empty one (only the end id); a null key is
written and scanned but not indexed; rows of an equal key are all written and
scanned in order of their text, and the index points at the first; an empty
table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import scratch
from weft.llm.bpe import UnitEncoder
from weft.llm.textops import mix, text_chunks

U = np.uint64
BUCKET = 4
MANIFEST = "shard int, stem string, n_docs long, n_keys long, n_buckets long, n_ids long, width int, first_key long, last_key long"


# --- minimal perfect hash -------------------------------------------------

def _slots(keys: np.ndarray, d, n: int) -> np.ndarray:
    return (mix(keys + U(0x9E3779B97F4A7C15) * np.asarray(d, U)) % U(n)).astype(np.int64)


def _bucket_of(keys: np.ndarray, m: int) -> np.ndarray:
    return (mix(keys ^ U(0x2545F4914F6CDD1D)) % U(m)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys * U(0xC2B2AE3D27D4EB4F) + U(7)) >> U(32)).astype(np.uint32)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements by bucket, slot by key) for distinct uint64 keys.

    Buckets are placed from the largest down: each tries displacements until
    all its keys fall on free, different slots. A bucket of one key takes any
    free slot, stored as ``-1 - slot``, so the last ones need no search."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    m = -(-n // BUCKET)
    b = _bucket_of(keys, m)
    order = np.argsort(b, kind="stable")
    size = np.bincount(b, minlength=m)
    at = np.concatenate(([0], np.cumsum(size)))
    disp, slot = np.zeros(m, np.int32), np.zeros(n, np.int64)
    free = np.ones(n, bool)
    tries = np.arange(1, 33, dtype=U)
    for j in np.argsort(-size, kind="stable"):
        own = order[at[j]:at[j + 1]]
        if len(own) < 2:
            break
        d0 = 0
        while True:
            cand = _slots(keys[own][None, :], (tries + U(d0))[:, None], n)
            good = free[cand].all(axis=1)
            if len(own) > 1:
                s = np.sort(cand, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                disp[j] = d0 + int(tries[hit[0]])
                slot[own] = cand[hit[0]]
                free[slot[own]] = False
                break
            d0 += len(tries)
    single = np.flatnonzero(size == 1)
    own = order[at[single]]
    slot[own] = np.flatnonzero(free)[:len(own)]
    disp[single] = -1 - slot[own]
    return disp, slot


def find_slots(keys: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key by the index alone (any slot for a stranger)."""
    d = np.asarray(disp[_bucket_of(keys, len(disp))]).astype(np.int64)
    return np.where(d < 0, -1 - d, _slots(keys, np.maximum(d, 0).astype(U), n))


# --- writing ---------------------------------------------------------------

def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2,
                key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Write the documents' ids and return the manifest, one row per shard.

    Keys are dealt out by range (``shards``: the session's shuffle partitions),
    sorted within each shard, encoded and written by its task in a stream."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = UnitEncoder(tokenizer)
        wide = np.dtype("<u4") if enc.tok.get_vocab_size() > 65536 or end_id > 65535 else np.dtype("<u2")
        stem = scratch.attempt_name("shard", shard)
        fs, path = scratch.locate(folder)
        fs.create_dir(path, recursive=True)
        keys, nulls, sizes, out = [], [], [], None
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                ids, at = enc.encode(data, offs)
                n_doc = len(offs) - 1
                withend = np.insert(ids, at[1:], end_id).astype(wide)
                out = out or fs.open_output_stream(f"{path}/{stem}.ids")
                out.write(withend.tobytes())
                k = part.column(0)
                nulls.append(np.asarray(k.is_null()))
                keys.append(k.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                sizes.append(np.diff(at) + 1)
                assert len(keys[-1]) == n_doc
        if out is None:
            return
        out.close()
        key_, null, size = map(np.concatenate, (keys, nulls, sizes))
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        # indexed: the first row of each key that is not null (rows are sorted by key)
        named = np.flatnonzero(~null & np.concatenate(([True], (key_[1:] != key_[:-1]) | null[:-1])))
        ukeys = key_[named].view(U)
        disp, slot = build_mph(ukeys)
        fp, first, length = np.zeros(len(named), "<u4"), np.zeros(len(named), "<u8"), np.zeros(len(named), "<u4")
        fp[slot], first[slot], length[slot] = fingerprints(ukeys), start[named], size[named]
        scratch.write_bytes(f"{folder}/{stem}.docs", np.stack([key_, null.astype(np.int64), start], 1).astype("<i8"))
        scratch.write_bytes(f"{folder}/{stem}.mph", first, disp.astype("<i4"), fp, length)
        some = key_[~null]
        yield pa.RecordBatch.from_pylist([dict(
            shard=shard, stem=stem, n_docs=len(key_), n_keys=len(named), n_buckets=len(disp), n_ids=int(size.sum()),
            width=wide.itemsize, first_key=int(some[0]) if len(some) else None, last_key=int(some[-1]) if len(some) else None)],
            schema=_arrow(MANIFEST))

    return scratch.stored(rows.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


# --- reading ---------------------------------------------------------------

class Shard:
    """One shard's arrays, memory-mapped."""

    def __init__(self, folder: str, m: dict):
        base = f"{folder}/{m['stem']}"
        n, b = m["n_keys"], m["n_buckets"]
        self.ids = scratch.map_array(f"{base}.ids", f"<u{m['width']}")
        self.first = scratch.map_array(f"{base}.mph", "<u8", n, 0)
        self.disp = scratch.map_array(f"{base}.mph", "<i4", b, 8 * n)
        self.fp = scratch.map_array(f"{base}.mph", "<u4", n, 8 * n + 4 * b)
        self.length = scratch.map_array(f"{base}.mph", "<u4", n, 12 * n + 4 * b)
        self.docs_uri, self.n_docs, self.n_keys = f"{base}.docs", m["n_docs"], n

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first id, number of ids) of int64 keys, by the index."""
        if not self.n_keys:
            z = np.zeros(len(keys), np.int64)
            return z.astype(bool), z, z
        k = keys.view(U)
        s = find_slots(k, self.disp, self.n_keys)
        return self.fp[s] == fingerprints(k), self.first[s].astype(np.int64), self.length[s].astype(np.int64)

    def payload(self, first: int, n: int) -> np.ndarray:
        return np.asarray(self.ids[first:first + n]).astype("<u4")


def scan_store(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document from the files: key, place among all ids, number of ids
    and the crc32 of its ids as unsigned 32-bit little endian.

    Each shard's task looks its keys up in the index and reads what the index
    names; only rows it doesn't name (null keys, and all but the first row of a
    repeated key) come from the document list. An index that misses a stored key,
    or names another place than the list has, raises an error."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key long, start long, n_ids long, ids_crc32 long, indexed boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in (r for b in batches for r in b.to_pylist()):
            s = Shard(folder, m)
            docs = np.asarray(scratch.map_array(s.docs_uri, "<i8")).reshape(-1, 3)
            end = np.append(docs[1:, 2], m["n_ids"])
            for at in range(0, len(docs), 20_000):
                d, e = docs[at:at + 20_000], end[at:at + 20_000]
                found, first, length = s.find(np.ascontiguousarray(d[:, 0]))
                before = docs[at - 1:at, :2] if at else np.array([[0, 1]])
                before = np.concatenate((before, d[:-1, :2]))
                via = (d[:, 1] == 0) & ((d[:, 0] != before[:, 0]) | (before[:, 1] == 1))
                wrong = via & ~(found & (first == d[:, 2]))
                if wrong.any():
                    raise ValueError(f"the index of {m['stem']} doesn't lead to key {d[wrong, 0][0]}")
                first, length = np.where(via, first, d[:, 2]), np.where(via, length, e - d[:, 2])
                crc = [zlib.crc32(s.payload(i, j)) for i, j in zip(first.tolist(), length.tolist())]
                yield scratch.arrow_batch(_arrow(schema), key=pa.array(d[:, 0], mask=d[:, 1] == 1), start=first + m["before"],
                                          n_ids=length, ids_crc32=np.array(crc, np.int64), indexed=via)

    return manifest.withColumn("before", before).repartition(n, "shard").mapInArrow(read, schema)


SALTS = 8


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """The ids of each wanted key (one row per distinct key), ``ids`` null where the
    store has no such key.

    A key's shard is searched among the shards' sorted bounds, which go with the
    tasks (a few numbers per shard); a shard's wanted keys are then read by up to
    ``SALTS`` tasks, with one shard open at a time in each."""
    shards = sorted((r.asDict() for r in manifest.where("first_key is not null").collect()), key=lambda m: m["first_key"])
    low, high = (np.array([m[c] for m in shards], np.int64) for c in ("first_key", "last_key"))
    schema = "key long, found boolean, ids array<long>"
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(low, k, "right") - 1
            none = np.asarray(b.column(0).is_null()) | (at < 0)
            if len(shards):
                none |= k > high[np.maximum(at, 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64(), mask=none)], names=["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, Shard] = {}
        out = pa.schema([("key", pa.int64()), ("found", pa.bool_()), ("ids", pa.list_(pa.int64()))])
        for b in batches:
            rows = []
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = None
                if i is not None:
                    if i not in open_:
                        open_ = {i: Shard(folder, shards[i])}  # rows come sorted by shard
                    found, first, size = open_[i].find(np.array([k], np.int64))
                    ids = open_[i].payload(int(first[0]), int(size[0])).tolist() if found[0] else None
                rows.append({"key": k, "found": ids is not None, "ids": ids})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    want = keys.select(F.col(key).cast("long").alias("key")).distinct()
    placed = want.mapInArrow(place, "key long, shard long")
    return placed.repartition(n, "shard", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("shard").mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: write all documents of the table, read the files back."""
    import public_tokenizers

    folder = scratch.new_folder(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return scan_store(manifest, folder).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32", "indexed")
