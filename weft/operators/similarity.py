"""Vector retrieval, near-duplicate consolidation and majority vote.

Vectors are ``ARRAY<FLOAT>`` of unit length. Bulk scoring (J10 retrieval,
J11 candidate checks) runs on whole Arrow batches with numpy; the small
per-label centroid norms use the native ``zip_with`` + ``aggregate`` dot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.blocks import Blocks, matrix, write_blocks
from weft.sources.tabular import written

SIMILARITY_THRESHOLD = 0.7        # retrieval cut-off (declared)
CONSOLIDATION_THRESHOLD = 0.95    # near-duplicate cut-off (declared)
QUERY_BLOCK = 1024                # query vectors a task holds at once
CORPUS_ROWS = 4096                # corpus vectors it scores against them at once
FIRST = 4096                      # smallest ids that are compared with all vectors
BUCKET, BITS = 4096, 8            # unrelated vectors of a bucket; bits of its key at least, as fewer save nothing
PART_ROWS, CUTS = 16_384, 64      # rows of a bucket that meet at once; the parts it can be cut into


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, summed left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def label_centroids(vectors: DataFrame, vec: str = "embedding", label: str = "label"
                    ) -> DataFrame:
    """Unit-normalised mean vector per label: ``(label, centroid)``. The
    per-(label, position) means are partial aggregates; the final arrays
    hold one entry per dimension."""
    x = vectors.select(label, F.posexplode(vec).alias("pos", "v"))
    c = x.groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    arr = c.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a"))
    vals = F.transform("a", lambda s: s["v"])
    norm = F.sqrt(dot(vals, vals))
    return arr.select(label, F.transform(vals, lambda v: v / norm).alias("centroid"))


def _topk_fn(folder: str, k: int, threshold):
    """mapInArrow body: score the corpus rows of a task against all query blocks,
    one block and ``CORPUS_ROWS`` rows at a time (one matrix product each). Per
    query the task keeps one number, a score that ``k`` of its rows have reached;
    only rows that reach it leave the task (ties too, so the top-k stays exact)."""
    def fn(batches):
        blocks, reached = Blocks(folder), {}
        for b in batches:
            for at in range(0, b.num_rows, CORPUS_ROWS):
                part = b.slice(at, CORPUS_ROWS)
                x = matrix(part.column(1))
                kk = min(k, len(x))
                for i, ids, queries in blocks:
                    scores = x @ queries.T                                  # rows x queries
                    floor = reached.setdefault(i, np.full(len(ids), -np.inf if threshold is None else float(threshold)))
                    if kk == k:
                        np.maximum(floor, -np.partition(-scores, kk - 1, axis=0)[kk - 1], out=floor)
                    r, q = np.nonzero(scores >= floor)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.column(0).take(pa.array(r)), pa.array(scores[r, q])],
                                                         names=["query_id", b.schema.names[0], "s"])
    return fn


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 10,
                threshold: float | None = SIMILARITY_THRESHOLD, key: str = "vec_id",
                vec: str = "embedding", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """For each query, the ``k`` corpus vectors with the largest inner
    product at or above ``threshold`` (ties to the smaller id).

    Both sides are distributed tables: tasks write the queries as block files
    in the shared folder (:mod:`weft.sources.blocks`), and one pass over the
    corpus meets every block of queries with every block of rows. A task holds
    one block of each, and one number per query; the plan is the same for any
    number of queries, and no query passes the driver. The final per-query top-k
    runs on the few rows that leave the tasks. Null vectors match nothing.
    """
    folder = write_blocks(queries, qid, qvec, QUERY_BLOCK)
    qtype = queries.schema[qid].dataType.simpleString()
    ktype = corpus.schema[key].dataType.simpleString()
    found = corpus.select(key, vec).where(F.col(vec).isNotNull()).mapInArrow(
        _topk_fn(folder, k, threshold), f"query_id {qtype}, {key} {ktype}, s double")
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), F.col(key).asc())
    return (found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
            .select("query_id", "rank", key, F.col("s").cast("decimal(18,6)").alias("score")))


def lsh_shape(n: int, threshold: float, miss: float, bucket: int = 8) -> tuple[int, int]:
    """(bits, tables) of sign-projection keys for ``n`` vectors.

    Two unit vectors of inner product ``s`` agree in a sign with probability
    ``1 - acos(s) / pi``; unrelated ones in half of all cases. The bits grow
    with ``log2(n)``, so that a bucket holds about ``bucket`` unrelated vectors
    however many there are, and the tables are as many as bring the chance
    that a pair at the threshold shares no bucket down to ``miss``."""
    same = 1.0 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(1, math.ceil(math.log2(max(n, 2) / bucket)))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(same ** bits, 1 - 1e-12))))


def _rows_of(col: pa.Array, dim: int) -> np.ndarray:
    x = matrix(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
    if len(x) and (x.shape[1] != dim or pc.min_max(pc.list_value_length(col))["min"].as_py() != dim):
        raise ValueError(f"vectors of different lengths, not all of {dim}")
    return x


def _nearest_first(x: np.ndarray, own: np.ndarray, tiles, threshold: float) -> np.ndarray:
    """Per row of ``x`` the smallest id, below its ``own``, of a vector with inner
    product >= ``threshold``; -1 for none. ``tiles`` gives (ids, vectors) by
    ascending id: a row leaves with its first hit, so where much is near, little
    is compared, and only one tile of scores is held."""
    found, left = np.full(len(x), -1, np.int64), np.arange(len(x))
    for ids, y in tiles:
        left = left[own[left] > ids[0]]
        if not len(left):
            break
        for at in range(0, len(left), CORPUS_ROWS):
            r = left[at:at + CORPUS_ROWS]
            hit = (x[r] @ y.T >= threshold) & (ids[None, :] < own[r][:, None])
            first = hit.argmax(axis=1)
            some = hit[np.arange(len(r)), first]
            found[r[some]] = ids[first[some]]
        left = left[found[left] < 0]
    return found


def _sweep_fn(folder: str, dim: int, threshold: float):
    """mapInArrow body on (i, vec): adds ``p``, what :func:`_nearest_first` finds in the blocks of a folder."""
    def fn(batches):
        tiles = None
        for b in batches:
            if b.num_rows:
                if tiles is None:
                    blocks = list(Blocks(folder))
                    ids = np.concatenate([ids.to_numpy() for _, ids, _ in blocks])
                    order = np.argsort(ids)
                    ids, y = ids[order], np.concatenate([y for _, _, y in blocks])[order]
                    tiles = [(ids[at:at + QUERY_BLOCK], y[at:at + QUERY_BLOCK]) for at in range(0, len(ids), QUERY_BLOCK)]
                p = _nearest_first(_rows_of(b.column(1), dim), b.column(0).to_numpy(), tiles, threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, mask=p < 0), b.column(1)], names=["i", "p", "v"])
    return fn


def _bucket_fn(dim: int, bits: int, tables: int, seed: int, vectors: bool):
    """mapInArrow body on (i, open, v): per vector and table, its signs along ``bits``
    random directions as one number (the bucket); with the vector or the keys alone."""
    def fn(batches):
        planes = np.random.default_rng(seed).standard_normal((tables, dim, bits))
        weight = (1 << np.arange(bits, dtype=np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows_of(b.column(2), dim)
            for t in range(tables):
                keys = [pa.array(np.full(len(x), t, np.int32)), pa.array(((x @ planes[t]) >= 0).astype(np.int64) @ weight)]
                yield pa.RecordBatch.from_arrays(keys + b.columns[:3 if vectors else 1], names=["t", "sig", "i", "open", "v"][:5 if vectors else 3])
    return fn


def _meet_fn(dim: int, threshold: float):
    """applyInArrow body on the rows of one group: those that ``ask`` against those that are ``held``."""
    def fn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        asking, held = rows.filter(rows["ask"]), rows.filter(rows["held"])
        own, ids, y = asking["i"].to_numpy(), held["i"].to_numpy(), _rows_of(held["v"], dim) if held.num_rows else None
        tiles = ((ids[at:at + QUERY_BLOCK], y[at:at + QUERY_BLOCK]) for at in range(0, len(ids), QUERY_BLOCK))
        p = _nearest_first(_rows_of(asking["v"], dim), own, tiles, threshold) if len(own) else np.zeros(0, np.int64)
        return pa.table({"i": pa.array(own[p >= 0], pa.int64()), "p": pa.array(p[p >= 0], pa.int64())})
    return fn


def _bucket_partners(rest: DataFrame, dim: int, bits: int, tables: int, threshold: float, seed: int, part_rows: int) -> DataFrame:
    """(i, p) for the rows of ``rest`` (i, open, v) that are open: the smallest near ids
    in their buckets. A group holds a whole bucket, or, of a bucket of more than
    ``part_rows``, its first part (by id) and the open rows of one part. What
    finds nothing there goes on to the later parts below it."""
    kind = rest.schema["v"].dataType.simpleString()
    keys = rest.mapInArrow(_bucket_fn(dim, bits, tables, seed, False), "t int, sig long, i long")
    full = written(keys.groupBy("t", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows), "vector-full")
    every = F.ceil(F.lit(CUTS) / F.least(F.lit(CUTS), F.ceil(F.col("n") / part_rows))).cast("int")
    full = keys.join(F.broadcast(full), ["t", "sig"]).groupBy("t", "sig", "n").agg(
        F.percentile_approx("i", [k / CUTS for k in range(1, CUTS)], CUTS * 20).alias("cuts"))
    full = written(full.select("t", "sig", F.array_distinct(F.filter("cuts", lambda c, k: (k + 1) % every == 0)).alias("cuts")), "vector-cuts")
    rows = rest.mapInArrow(_bucket_fn(dim, bits, tables, seed, True), f"t int, sig long, i long, open boolean, v {kind}") \
               .join(F.broadcast(full), ["t", "sig"], "left")
    rows = rows.withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("i"))), F.lit(0))) \
               .withColumn("last", F.coalesce(F.size("cuts"), F.lit(0)))
    out = "i long, p long"

    def met(placed: DataFrame, *group: str) -> DataFrame:
        return placed.select(*group, "i", "v", "ask", "held").groupBy(*group).applyInArrow(_meet_fn(dim, threshold), out)

    first = rows.where("open OR part = 0").withColumn("held", F.col("part") == 0).select(
        "*", F.explode(F.when(F.col("held"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array("part"))).alias("chunk"))
    found = written(met(first.withColumn("ask", F.col("open") & (F.col("chunk") == F.col("part"))), "t", "sig", "chunk"), "vector-first-parts")
    if not full.limit(1).count():
        return found
    # the later parts of over-full buckets, down to the smallest near id known by now
    best = found.groupBy("i").agg(F.min("p").alias("p"))
    later = rows.where("last > 0 AND part > 0")
    asks = later.where("open").join(best, "i", "left").withColumn("below", F.coalesce("p", "i")) \
                .select("t", "sig", "i", "v", F.col("part").alias("chunk"), F.explode(F.filter(F.sequence(F.lit(1), F.col("part")), lambda k: F.element_at(
                    "cuts", k) < F.col("below"))).alias("part"), F.lit(True).alias("ask"), (F.lit(False)).alias("held"))
    asks = written(asks, "vector-later")
    if not asks.limit(1).count():
        return found
    holds = later.select("t", "sig", "i", "v", "part").join(asks.select("t", "sig", "part", "chunk").distinct(), ["t", "sig", "part"]) \
                 .select("t", "sig", "i", "v", "chunk", "part", F.lit(False).alias("ask"), F.lit(True).alias("held"))
    return found.unionByName(met(asks.unionByName(holds), "t", "sig", "part", "chunk"))


def consolidate_near_duplicates(vectors: DataFrame, threshold: float = CONSOLIDATION_THRESHOLD,
                                key: str = "vec_id", vec: str = "embedding",
                                miss: float = 1e-6, seed: int = 7, first: int = FIRST, part_rows: int = PART_ROWS) -> DataFrame:
    """Map every vector to the smallest id among itself and the vectors
    with inner product >= ``threshold``; ids of any type that has an order.

    1. Exact copies collapse first with an aggregate on the vector itself,
       so a huge group of identical vectors never forms pairs. The distinct
       ones get numbers in the order of their ids.
    2. Every vector is compared with the ``first`` ones, smallest first, until
       one is near. A hit there is its answer, so where much is near (few
       dimensions, large groups of copies) this pass settles nearly all.
    3. The others are open. All get bucket keys by the signs of random projections,
       shaped by :func:`lsh_shape`: a bucket holds a few thousand unrelated vectors,
       which one matrix product compares, and a true pair at the threshold
       shares no bucket with probability ``miss`` (closer pairs with less). Each
       vector is sent once per table, no pair is ever a row, and over-full
       buckets are cut (:func:`_bucket_partners`).
    Every comparison is exact (inner product >= threshold).
    """
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size(vec)).alias("d")).first()["d"]
    if not dim or dim < 0:
        return vectors.select(key, F.col(key).alias("canonical_id"))
    # 1. exact copies, numbered by id: ranges of ids lie in partitions in order
    groups = vectors.groupBy(vec).agg(F.min(key).alias("rep"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = written(groups.repartitionByRange(n, "rep").sortWithinPartitions("rep").withColumn("i", F.monotonically_increasing_id()), "vector-groups")
    members = vectors.join(groups, vec, "inner").select(key, "rep")
    reps = groups.where(F.col("rep").isNotNull() & F.col(vec).isNotNull()).select("i", F.col(vec).alias("v"))
    kind = reps.schema["v"].dataType.simpleString()
    # 2. the smallest ids against all
    firsts = reps.orderBy("i").limit(first)
    swept = written(reps.mapInArrow(_sweep_fn(write_blocks(firsts, "i", "v", QUERY_BLOCK), dim, threshold), f"i long, p long, v {kind}"), "vector-swept")
    found = swept.where(F.col("p").isNotNull()).select("i", "p")
    # 3. buckets of the others
    last = firsts.agg(F.max("i")).first()[0]
    rest = swept.where(F.col("i") > last).select("i", F.col("p").isNull().alias("open"), "v")
    size = rest.agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open")).first()
    if size["open"]:
        bits, _ = lsh_shape(size["n"], threshold, miss, BUCKET)
        bits, tables = lsh_shape(2 ** max(BITS, bits), threshold, miss, 1)
        found = found.unionByName(_bucket_partners(rest, dim, bits, tables, threshold, seed, part_rows))
    partner = found.groupBy("i").agg(F.min("p").alias("p"))
    ids = groups.select("i", "rep")
    canon = ids.join(partner, "i", "left").join(ids.select(F.col("i").alias("p"), F.col("rep").alias("near")), "p", "left") \
               .groupBy("rep").agg(F.min(F.coalesce("near", "rep")).alias("canonical_id"))
    return members.join(canon, "rep", "inner").select(key, "canonical_id")


def majority_vote(df: DataFrame, item: str, label: str) -> DataFrame:
    """The most frequent label per item; ties go to the smallest label.
    Counts are a partial aggregate; the pick is ``min_by`` on (-count, label),
    for labels of any type that has an order."""
    counts = df.groupBy(item, label).agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy(item).agg(
        F.min_by(F.col(label), F.struct(-F.col("votes"), F.col(label))).alias(label),
        F.max("votes").alias("votes"))
