"""Conversation prefix trie in minimal-perfect-hash node tables (operator 11).

Each distinct sequence of the first d turns (role, text) of a conversation is a
node. Texts are read once, into a 128-bit hash and a word count per turn; a
prefix's digest is the exclusive or of its turns' hashes mixed with their places,
two 64-bit lanes wide, so that any stretch of a conversation can be digested by
itself.

1. Turns are dealt out by range of (conv_id, turn, hashes) and packed per
   conversation in order; running counts over the packs alone give each its
   place. Conversations are cut at every ``segment`` turns, whatever their length.
2. Segments are dealt out by range of their first turns, so that conversations
   that begin alike stand together, and a popular beginning is spread over as
   many tasks as it needs. A task closes a node table (a shard) whenever it holds
   ``shard`` turns: the distinct prefix digests are enumerated, a minimal perfect
   hash gives each a slot, both lanes stored in the slot are compared with every
   digest that was sent to it (another seed is taken if any differs), and counts,
   least conv_id, ends and parent slots are scattered into flat arrays.
3. A node's counts are summed over the shards that hold it. Its owner is its
   least member, which lies in one shard; there the node adds its own leaf and
   saved tokens, and each shard accumulates through its parent slots, deepest
   first. Shard sums of a node add up, since every owned node is counted in one
   shard only. What lies below a segment's end enters at its last slot, from sums
   per conversation and segment.
4. A node's ends are hashed in order of conv_id from chunks that shards pack; a
   SHA-256 runs over its bytes one by one, so the chunks of one node are streamed
   through one task, one chunk in memory.

Edge cases: turns are read by turn number (null first), equal numbers in order of
their content's hash; every row is a turn, repeated rows too; a null role or text
is empty; rows without conv_id belong to no conversation and are left out; a
conversation whose turns are all replaced by those of an absent donor is
turnless, and a member and end of the root; an empty table gives no rows; other
columns are not read. ``c % 20`` keeps the sign of c, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import scratch
from weft.llm.op10_token_store import build_mph, find_slots
from weft.llm.textops import mix

U = np.uint64
SEGMENT = 4096      # turns of one conversation in one piece
SHARD = 1 << 18     # turns in one node table
WORD = r"[^\x20\x09-\x0D]+"
LANES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _ints(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of ``values`` between consecutive places of ``at``, as binary values."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype("<i4")), pa.py_buffer(values)])


# --- conversations in pieces -------------------------------------------------

PACK = "conv_id long, pack long, n long, keys binary, words binary"


def packed(turns: DataFrame, segment: int) -> DataFrame:
    """Runs of a conversation's turns in order: their hashes and word counts."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("w"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            conv = _ints(b.column("conv_id"))
            run = np.append(np.flatnonzero(np.append(True, conv[1:] != conv[:-1])), len(conv))
            at = np.unique(np.concatenate([run] + [np.arange(x, y, segment) for x, y in zip(run[:-1], run[1:]) if y - x > segment]))
            yield scratch.arrow_batch(_schema(PACK), conv_id=conv[at[:-1]], pack=number + np.arange(len(at) - 1), n=np.diff(at),
                                      keys=_binaries(np.stack([_ints(b.column("k1")), _ints(b.column("k2"))], 1), at),
                                      words=_binaries(_ints(b.column("w")).astype("<i4"), at))
            number += len(at) - 1

    return t.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "w").mapInArrow(pack, PACK)


def segments(turns: DataFrame, folder: str, head: Column, donor: Column, max_head: int, segment: int) -> DataFrame:
    """Conversations cut at every ``segment`` turns: (conv_id, seg, last, keys, words, x1, x2) with
    ``last`` the turns of the whole conversation and x1, x2 the digest of all before the segment."""
    packs = scratch.stored(packed(turns, segment), f"{folder}/packs")
    conv = Window.partitionBy("conv_id")
    # where each pack stands, from the packs' sizes alone; the first turns go along for those that borrow them
    slim = packs.select("conv_id", "pack", "n", F.substring("keys", 1, 16 * max_head).alias("k"), F.substring("words", 1, 4 * max_head).alias("w"))
    slim = slim.withColumn("before", F.coalesce(F.sum("n").over(conv.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
               .withColumn("total", F.sum("n").over(conv)).withColumn("h", head.cast("long")).withColumn("donor", donor)

    def joined(field: str, width: int) -> Column:
        whole = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x[field]))
        return F.substring(whole, 1, width * max_head)

    heads = slim.where(F.col("before") < max_head).groupBy(F.col("conv_id").alias("donor")).agg(
        F.array_sort(F.collect_list(F.struct("before", "k", "w"))).alias("l")).select(
        "donor", joined("k", 16).alias("head_k"), joined("w", 4).alias("head_w"))
    plan = slim.drop("k", "w", "conv_id", "n").join(heads, "donor", "left").drop("donor")
    placed = packs.join(plan, "pack").select("conv_id", "keys", "words", "before", "total", "h", "head_k", "head_w")
    ddl = "conv_id long, seg long, off long, last long, keys binary, words binary, x1 long, x2 long"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                keys, words, start = r["keys"], r["words"], 0
                lent = min(r["h"], len(r["head_w"] or b"") // 4)
                skip = min(max(r["h"] - r["before"], 0), len(words) // 4)
                keys, words = keys[16 * skip:], words[4 * skip:]
                if r["before"] == 0:
                    keys, words = (r["head_k"] or b"")[:16 * lent] + keys, (r["head_w"] or b"")[:4 * lent] + words
                else:
                    start = lent + max(r["before"] - r["h"], 0)
                last, end = lent + max(r["total"] - r["h"], 0), start + len(words) // 4
                k = np.frombuffer(keys, U).reshape(-1, 2)
                for a in [start] * (last == 0 and r["before"] == 0) + ([start, *range(start // segment * segment + segment, end, segment)] if end > start else []):
                    z = min(a // segment * segment + segment, end)
                    part = k[a - start:z - start]
                    x = [int(np.bitwise_xor.reduce(turn_marks(part[:, i], np.arange(a + 1, z + 1), i)).view(np.int64)) for i in (0, 1)]
                    out.append(dict(conv_id=r["conv_id"], seg=a // segment, off=a, last=last, keys=part.tobytes(),
                                    words=words[4 * (a - start):4 * (z - start)], x1=x[0], x2=x[1]))
            yield pa.RecordBatch.from_pylist(out, schema=_schema(ddl))

    def whole(field: str) -> Column:
        return F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x[field]))

    segs = placed.mapInArrow(lay, ddl).groupBy("conv_id", "seg").agg(
        F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("off", "keys", "words"))).alias("l"),
        F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    segs = scratch.stored(segs.select("conv_id", "seg", "last", whole("keys").alias("keys"), whole("words").alias("words"), "y1", "y2"), f"{folder}/segments")
    # only conversations of several segments need the digest of what came before
    earlier = conv.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    long_ = segs.where(F.col("last") > segment)
    base = long_.select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"y{i}").over(earlier), F.lit(0)).alias(f"x{i}") for i in (1, 2)])
    kept = ["conv_id", "seg", "last", "keys", "words", "x1", "x2"]
    return segs.where(F.col("last") <= segment).withColumn("x1", F.lit(0).cast("long")).withColumn("x2", F.lit(0).cast("long")).select(*kept) \
               .unionByName(long_.join(base, ["conv_id", "seg"]).select(*kept))


def turn_marks(keys: np.ndarray, depth: np.ndarray, lane: int) -> np.ndarray:
    """A turn's part of every prefix that holds it, by its hash and its place (from 1)."""
    return mix(keys + LANES[lane] * depth.astype(U))


# --- node tables ---------------------------------------------------------------

class NodeTable:
    """The trie of some segments: one slot per distinct prefix, flat arrays over the slots.

    A segment's rows are the prefix it begins at and one per turn. The prefix a
    later segment begins at is a slot of its own (``border``), without a parent here."""

    def __init__(self, pieces: list[dict], segment: int):
        n = np.array([len(p["words"]) // 4 for p in pieces])
        first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
        size = int((n + 1).sum())
        piece = np.repeat(np.arange(len(pieces)), n + 1)
        seg, self.conv, last = (np.array([p[c] for p in pieces], np.int64) for c in ("seg", "conv_id", "last"))
        turn = np.ones(size, bool)
        turn[first] = False
        depth = np.arange(size) - first[piece] + segment * seg[piece]
        keys = np.frombuffer(b"".join(p["keys"] for p in pieces), U).reshape(-1, 2)
        digest = []
        for lane in (0, 1):
            marks = np.zeros(size, U)
            marks[turn] = turn_marks(keys[:, lane], depth[turn], lane)
            before = np.array([p[f"x{lane + 1}"] for p in pieces], np.int64).view(U)
            run = np.bitwise_xor.accumulate(marks)
            digest.append(mix((run ^ run[first][piece] ^ before[piece]) + LANES[1 - lane] * (depth + 1).astype(U)))
        border = ~turn & (seg[piece] > 0)
        slot = self._slots(digest, border)
        m = self.size = int(slot.max()) + 1
        self.digest = [self._flat(m, slot, d, U) for d in digest]
        self.depth, self.border = self._flat(m, slot, depth, np.int64), self._flat(m, slot, border, bool)
        words = np.zeros(size, np.int64)
        words[turn] = np.frombuffer(b"".join(p["words"] for p in pieces), "<i4")
        self.words = self._flat(m, slot, words, np.int64)
        self.parent = np.full(m, -1)
        inner = np.flatnonzero(turn)
        self.parent[slot[inner]] = slot[inner - 1]
        self.n = np.bincount(slot[~border], minlength=m)
        self.least = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(self.least, slot[~border], self.conv[piece][~border])
        bottom, end = first + n, last == segment * seg + n
        self.ends = np.bincount(slot[bottom[end]], minlength=m)
        self.end_slot, self.end_conv = slot[bottom[end]], self.conv[end]
        self.on_slot, self.on_conv, self.on_seg = slot[bottom[~end]], self.conv[~end], seg[~end]

    @staticmethod
    def _flat(m: int, slot: np.ndarray, values: np.ndarray, dtype) -> np.ndarray:
        out = np.zeros(m, dtype)
        out[slot] = values
        return out

    @staticmethod
    def _slots(digest: list[np.ndarray], border: np.ndarray) -> np.ndarray:
        """Each row's slot by the minimal perfect hash of its digest, verified."""
        seed = 0
        while True:
            key = mix(digest[0] + mix(digest[1] + U(2 * seed + 1) * border.astype(U) + U(seed)))
            distinct = np.unique(key)
            displaced, _ = build_mph(distinct)
            slot = find_slots(key, displaced, len(distinct))
            held = np.zeros(len(distinct), np.int64)
            held[slot] = np.arange(len(slot))
            same = held[slot]
            if all((x[same] == x).all() for x in (*digest, border)):
                return slot
            seed += 1


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Add every slot's values to its parent's, deepest slots first."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        for v in values:
            np.add.at(v, parent[level], v[level])


NODE, END, ON = 0, 1, 2
LOCAL = ("kind int, d1 long, d2 long, shard long, slot long, parent long, depth long, border boolean, n long, least long, "
         "words long, ends long, conv_id long, seg long, ids string")


def node_tables(segs: DataFrame, segment: int, size: int) -> DataFrame:
    """The shards' rows: nodes, chunks of ends, and segments that go on."""
    n = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    like = [F.xxhash64(F.substring("keys", 1, 16 * d)).alias(f"g{d}") for d in (1, 2, 4)]
    order = ["x1", "g1", "g2", "g4", "conv_id", "seg"]
    fields = _schema(LOCAL)

    def rows(count: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in fields], schema=fields)

    def write(table: NodeTable, shard: int) -> Iterator[pa.RecordBatch]:
        d1, d2 = (d.view(np.int64) for d in table.digest)
        m = table.size
        yield rows(m, kind=np.full(m, NODE), d1=d1, d2=d2, shard=np.full(m, shard), slot=np.arange(m), parent=table.parent, depth=table.depth,
                   border=table.border, n=table.n, least=pa.array(table.least, mask=table.n == 0), words=table.words, ends=table.ends)
        by = np.lexsort((table.end_conv, table.end_slot))
        slot, conv = table.end_slot[by], table.end_conv[by].tolist()
        at = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(slot)) if len(slot) else np.zeros(1, int)
        ids = [",".join(map(str, conv[x:y])) for x, y in zip(at[:-1], at[1:])]
        yield rows(len(ids), kind=np.full(len(ids), END), d1=d1[slot[at[:-1]]], d2=d2[slot[at[:-1]]], conv_id=[conv[x] for x in at[:-1]], ids=ids)
        k = len(table.on_slot)
        yield rows(k, kind=np.full(k, ON), shard=np.full(k, shard), slot=table.on_slot, conv_id=table.on_conv, seg=table.on_seg)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, turns = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for p in b.to_pylist():
                held.append(p)
                turns += 1 + len(p["words"]) // 4
                if turns >= size:
                    yield from write(NodeTable(held, segment), shard)
                    shard, held, turns = shard + 1, [], 0
        if held:
            yield from write(NodeTable(held, segment), shard)

    dealt = segs.select("*", *like).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "seg", "last", "keys", "words", "x1", "x2").mapInArrow(build, LOCAL)


SUMS = "d1 long, d2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def shard_sums(key: tuple, table: pa.Table) -> pa.Table:
    """One shard's part of its nodes' sums (and, from a node's owner, what the node is)."""
    row = {c: _ints(table.column(c).combine_chunks()) for c in ("kind", "slot", "own", "leaf", "saved")}
    node = row["kind"] == NODE
    at = row["slot"][node].astype(np.int64)
    m = int(at.max()) + 1

    def flat(name: str) -> np.ndarray:
        out = np.zeros(m, np.int64)
        out[at] = _ints(table.column(name).combine_chunks().fill_null(0))[node]
        return out

    parent, depth, who = flat("parent"), flat("depth"), flat("who")
    own = flat("own").astype(bool)
    leaves, saved, children = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.add.at(leaves, row["slot"], row["leaf"])
    np.add.at(saved, row["slot"], row["saved"])
    born = np.flatnonzero(own & (parent >= 0))
    np.add.at(children, parent[born], 1)
    accumulate(parent, depth, leaves, saved)
    border = flat("border").astype(bool)
    leaves[border] = saved[border] = 0      # they enter through the segment above
    keep = np.flatnonzero(own | (leaves > 0) | (saved > 0) | (children > 0))
    up = parent[keep]
    other, orphan = ~own[keep], up < 0
    return pa.table([pa.array(flat("d1")[keep]), pa.array(flat("d2")[keep]), pa.array(who[keep], mask=other), pa.array(depth[keep], mask=other),
                     pa.array(who[up], mask=other | orphan), pa.array(flat("total")[keep], mask=other),
                     pa.array(children[keep]), pa.array(leaves[keep]), pa.array(saved[keep])], schema=_schema(SUMS))


def hashed_ends(local: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the nodes where conversations end."""
    n = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "d1 long, d2 long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for d1, d2, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (d1, d2) == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d1, d2), hashlib.sha256()
                sha.update(ids.encode())
            yield _rows(out, ddl)
        if key:
            yield _rows([(*key, sha.hexdigest())], ddl)

    chunks = local.where(F.col("kind") == END).select("d1", "d2", "conv_id", "ids")
    return chunks.repartition(n, "d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").select("d1", "d2", "ids").mapInArrow(run, ddl)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def prefix_trie(turns: DataFrame, head: Column | None = None, donor: Column | None = None, max_head: int = 3,
                segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """The trie of a table's conversations, one row per node.

    ``head``, ``donor``: a conversation's first ``head`` turns (at most ``max_head``) are taken
    from conversation ``donor`` instead, both expressions of ``conv_id``; by default each
    conversation is as it stands. ``segment``: turns of one piece; ``shard``: turns of one node table."""
    spark = turns.sparkSession
    folder = scratch.new_folder(spark, "trie")
    head, donor = F.lit(0) if head is None else head, F.col("conv_id") if donor is None else donor
    local = scratch.stored(node_tables(segments(turns, folder, head, donor, max_head, segment), segment, shard), f"{folder}/local")
    # a node's whole counts, on each of its rows: at most one per shard
    same = Window.partitionBy("d1", "d2")
    node = local.where(F.col("kind") == NODE).withColumn("total", F.sum("n").over(same)).withColumn("who", F.min("least").over(same)) \
                .withColumn("ends", F.sum("ends").over(same))
    own = F.coalesce(F.col("least") == F.col("who"), F.lit(False))
    node = node.select("kind", "shard", "slot", "d1", "d2", "parent", "depth", "border", "total", "who", own.alias("own"),
                       (own & (F.col("ends") == F.col("total"))).cast("long").alias("leaf"),
                       F.when(own, (F.col("total") - 1) * F.col("words")).otherwise(0).alias("saved"))
    node = scratch.stored(node, f"{folder}/nodes")
    # what a conversation owns below each of its segments, for those that go on
    below = node.where(F.col("own") & (F.col("depth") > segment)).groupBy(
        F.col("who").alias("conv_id"), F.floor((F.col("depth") - 1) / segment - 1).alias("seg")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg"))
    carried = local.where(F.col("kind") == ON).select("shard", "slot", "conv_id", "seg").join(below, ["conv_id", "seg"], "left").select(
        "shard", "slot", F.lit(ON).alias("kind"), *[F.sum(F.coalesce(c, F.lit(0))).over(later).alias(c) for c in ("leaf", "saved")])
    parts = node.unionByName(carried, allowMissingColumns=True)
    sums = parts.withColumn("own", F.coalesce("own", F.lit(False)).cast("int")).withColumn("border", F.coalesce("border", F.lit(False)).cast("int")) \
                .groupBy("shard").applyInArrow(shard_sums, SUMS)
    whole = sums.groupBy("d1", "d2").agg(*[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
                                         *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return whole.join(hashed_ends(local), ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the whole table, each conversation rebuilt with a beginning of another one."""
    c = F.col("conv_id")
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.crc32(c.cast("string").cast("binary")) % 4, c - c % 20)


#: crc32 by shifts, then lists of turns, their prefixes, and sums over all ancestors of a node.
ORACLE = r"""
WITH ids AS (
  SELECT conv_id, 4294967295 - list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
  SELECT o.conv_id, list_concat(coalesce(d.l, [])[1:crc % 4], o.l[crc % 4 + 1:]) AS l
  FROM own o JOIN ids USING (conv_id) LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 20),
member AS (
  SELECT conv_id, depth, l[1:depth] AS p, len(l) = depth AS ended
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM built)),
node AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM member GROUP BY depth, p),
child AS (
  SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_ AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN
           len(regexp_extract_all(n.p[n.depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM node n LEFT JOIN child c ON n.depth = c.depth AND n.p = c.p),
up AS (
  SELECT a AS depth, p[1:a] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN up u ON f.depth = u.depth AND f.p = u.p
LEFT JOIN node q ON q.depth = f.depth - 1 AND q.p = f.p[1:f.depth - 1]
"""
