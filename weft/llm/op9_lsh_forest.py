"""Near-duplicate groups by an LSH forest (operator 9).

A document's set is its distinct ``k``-word shingles. Documents of one set
(equal length and 128-bit set hash) are one class, and its smallest doc_id
stands for it, so a group of copies never forms pairs.

*Forest.* Each class has a MinHash signature of ``TREES * DEPTH`` values. Tree t
orders the classes by the signature read from its t-th block on (and on round
the end), so that neighbours in the order share the longest prefix. A region is
the classes that share a prefix. Depth adapts by region: a region of at most
``REGION`` classes is small enough that all its pairs are candidates; a larger
one (a crowd) offers each member its link to one member drawn by hash (another
in each tree) and to its hub, the member whose shingles are the commonest, and is cut
by a longer prefix.

*Confirmation.* Candidates whose lengths or 1-bit sketches exclude the threshold
by a wide margin go; the rest is confirmed on the full sets, computed from the
texts of the candidate documents alone. First each class is compared with its
nearest smaller candidate; components of what holds are contracted, and only
candidates between different components are compared after that, so a dense
group costs about one comparison a member.

*Crowds.* Two classes that share a region and were not compared stood in a crowd,
both of them. So the classes that ever stood in one are joined exactly: each
gives its rarest shingles, as many as any partner at the threshold must share one
of, and those of different components that share one, at places and of lengths
that allow the threshold, are confirmed too. Common shingles are dealt out by
salt. Shingles are ordered by counts of their hash slots; any order is right, a
good one makes few candidates.

A pair of similarity s is missed by every tree with probability at most
``(1 - s^2)^16`` (8e-8 at 0.8), whatever the sizes of its regions; it then may
still be joined through others. Confirmed links are exact.

Edge cases: a document without words has no shingles and stands alone; fewer
words than ``k`` are one shingle; a null doc_id links with nothing (component
null, kept); rows of an equal doc_id are one document, linked through any of its
texts, and stay or go together; empty tables give no rows; other columns are not
read by :func:`near_duplicates` and kept by :func:`first_of_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.components import components
from weft.llm.textops import WordHasher, combine, mix, text_chunks, windows

U = np.uint64
TREES, DEPTH = 16, 8
LEVELS = (2, 3, 4, 6, 8, 12, 16, 24)
REGION = 12
SLOTS = 20  # bits of a shingle hash that are counted
SHARE = 512  # rows of a common shingle that meet all others in one task
SLACK = 40  # of 128 sketch bits: a pair at 0.8 differs in 12.8, 40 is eight deviations more


class Shingler:
    """Distinct shingle hashes of the documents of a chunk."""

    def __init__(self, k: int):
        self.k, self.hasher = k, WordHasher(lower=True)

    def sets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct hashes by document, offsets by document)."""
        starts, ends, at = self.hasher.words(data, offs)
        h = self.hasher.hashes(data, starts, ends)
        g, _ = windows(h, at, self.k)
        n = np.diff(at)
        cut = np.concatenate(([0], np.cumsum(np.maximum(n - self.k + 1, 0))))
        out, size = [], np.zeros(len(n), np.int64)
        for i in range(len(n)):
            if n[i] >= self.k:
                s = np.sort(g[cut[i]:cut[i + 1]])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n[i]:
                s = combine([h[j:j + 1] for j in range(at[i], at[i + 1])], seed=1 + int(n[i]))
            else:
                continue
            out.append(s)
            size[i] = len(s)
        return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(size)))


def signatures(sets: np.ndarray, at: np.ndarray, n_hashes: int) -> np.ndarray:
    """MinHash values (documents x hashes, uint32); rows of empty sets are zero."""
    rng = np.random.default_rng(77)
    a = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, n_hashes), np.uint32)
    if len(full):
        for j in range(n_hashes):
            v = ((sets ^ b[j]) * a[j] >> U(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(v, at[:-1][full])
    return out


FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()),
                      ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])
FEATURES_DDL = "doc_id long, n long, key_a long, key_b long, s1 long, s2 long, sig binary"


def featured(docs: DataFrame, k: int) -> DataFrame:
    """Per document its set size, set hash, sketch (lowest signature bits) and signature
    (big endian, so that bytes order like numbers)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(k)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                s, at = sh.sets(data, offs)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((2, len(n)), U)
                if len(full):
                    for row, c in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                        keys[row, full] = np.add.reduceat(mix(s ^ U(c)), at[:-1][full])
                sig = signatures(s, at, TREES * DEPTH)
                sketch = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64).reshape(len(n), 2)
                sig = sig.astype(">u4")
                yield scratch.arrow_batch(FEATURES, doc_id=part.column(0), n=n, key_a=keys[0].view(np.int64), key_b=keys[1].view(np.int64),
                                          s1=sketch[:, 0], s2=sketch[:, 1],
                                          sig=pa.array([r.tobytes() for r in sig], pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, FEATURES_DDL)


def near_enough(both: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a < b, diff) of (x, y) whose lengths and sketches allow the threshold."""
    diff = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    return both.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), diff.alias("diff"),
                       F.least("x.n", "y.n").alias("lo"), F.greatest("x.n", "y.n").alias("hi")) \
               .where((F.col("a") < F.col("b")) & (F.col("diff") <= SLACK) & (100 * F.col("lo") >= threshold * F.col("hi"))).select("a", "b", "diff")


def forest_pairs(classes: DataFrame, folder: str, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, diff) of classes (rep, n, s1, s2, sig), and the rows
    (region, rep, n, s1, s2) of the crowds of all levels. Each level's regions and
    pairs are written as they are made, so no plan spans two levels."""
    spark = classes.sparkSession
    sig2 = F.concat("sig", "sig")
    rows = classes.select("rep", "n", "s1", "s2", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(
        sig2, 4 * DEPTH * t + 1, 4 * max(LEVELS)))).alias("tree", "label"))
    done = []
    for d in LEVELS:
        keyed = rows.withColumn("region", F.xxhash64("tree", F.substring("label", 1, 4 * d)))
        lead = F.min(F.struct(F.xxhash64("rep", "tree").alias("h"), F.col("rep"), "n", "s1", "s2"))
        regions = keyed.groupBy("region").agg(F.count("*").alias("members"), lead.alias("l")).where("members > 1")
        found = scratch.stored(keyed.join(regions, "region"), f"{folder}/level{d}")
        small = found.where(F.col("members") <= REGION).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "s1", "s2"))).alias("m"))
        small = small.select(F.posexplode("m").alias("i", "y"), "m").select("y", F.explode(F.slice("m", F.lit(1), F.col("i"))).alias("x"))
        large = found.where(F.col("members") > REGION)
        star = large.select(F.struct("rep", "n", "s1", "s2").alias("y"), F.struct("l.rep", "l.n", "l.s1", "l.s2").alias("x"))
        near = scratch.stored(near_enough(small.select("x", "y").union(star.select("x", "y")), threshold), f"{folder}/pairs{d}")
        done.append(d)
        rows = large.select("rep", "n", "s1", "s2", "tree", "label")
        if rows.isEmpty():
            break
    pairs = spark.read.schema(near.schema).parquet(*[f"{folder}/pairs{d}" for d in done])
    levels = spark.read.schema(found.schema).parquet(*[f"{folder}/level{d}" for d in done])
    return pairs, levels.where(F.col("members") > REGION).select("region", "rep", "n", "s1", "s2")


def slot_counts(sets: DataFrame, folder: str) -> str:
    """A file of how many shingles of ``sets`` (id, shingles) fall into each of
    ``2 ** SLOTS`` slots, which tasks map (4 MB, whatever the input)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            for x in b.column(1):
                np.add.at(total, (np.frombuffer(x.as_buffer(), U) >> U(64 - SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri = np.zeros(1 << SLOTS, "<i4"), f"{folder}/{scratch.attempt_name('counts', 0)}"
        for b in batches:
            out[b.column(0).to_numpy()] = np.minimum(b.column(1).to_numpy(), np.iinfo(np.int32).max)
        scratch.write_bytes(uri, out)
        yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

    slots = sets.mapInArrow(make, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return scratch.stored(slots.coalesce(1).mapInArrow(write, "uri string"), f"{folder}/counts").first()["uri"]


def hub_pairs(crowds: DataFrame, sets: DataFrame, counts: str, folder: str, threshold: int) -> DataFrame:
    """Candidate pairs of each member of a crowd with its hub, the member nearest to what they have in common."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scratch.map_array(counts, "<i4")
        for b in batches:
            score = []
            for x in b.column(1):
                s = np.frombuffer(x.as_buffer(), U)
                score.append(float(of[(s >> U(64 - SLOTS)).astype(np.int64)].sum(dtype=np.int64) / np.sqrt(len(s))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["rep", "score"])

    scores = scratch.stored(sets.select("id", "shingles").mapInArrow(make, "rep long, score double"), f"{folder}/scores")
    hubs = crowds.join(scores, "rep").groupBy("region").agg(F.max(F.struct("score", "rep", "n", "s1", "s2")).alias("h"))
    hubs = scratch.stored(hubs, f"{folder}/hubs")
    star = crowds.join(hubs, "region").select(F.struct("h.rep", "h.n", "h.s1", "h.s2").alias("x"), F.struct("rep", "n", "s1", "s2").alias("y"))
    return scratch.stored(near_enough(star, threshold).distinct(), f"{folder}/hub-pairs")


def rarest(sets: DataFrame, counts: str, threshold: int) -> DataFrame:
    """(id, n, at, token): of each set the rarest shingles and their places, one of
    which any set at the threshold shares."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("token", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scratch.map_array(counts, "<i4")
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                s = np.frombuffer(x.as_buffer(), U)
                n = len(s)
                m = n + 1 - -(-threshold * n // 100)
                top = s[np.lexsort((s, of[(s >> U(64 - SLOTS)).astype(np.int64)]))[:m]]
                yield scratch.arrow_batch(schema, id=np.full(len(top), i, np.int64), n=np.full(len(top), n, np.int64), at=np.arange(len(top)), token=top.view(np.int64))

    return sets.select("id", "shingles").mapInArrow(make, "id long, n long, at long, token long")


def crowd_pairs(sets: DataFrame, comp: DataFrame, counts: str, folder: str, threshold: int) -> DataFrame:
    """All pairs (a < b, ca, cb) of ``sets`` (id, shingles) in different components ``comp``
    (id, comp) that can reach the threshold, each once."""
    rows = scratch.stored(rarest(sets, counts, threshold).join(comp, "id"), f"{folder}/rarest")
    shared = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    rows = scratch.stored(rows.join(shared.select("token", F.ceil(F.col("m") / SHARE).alias("parts")), "token"), f"{folder}/shared")
    x = rows.select("token", F.pmod(F.xxhash64("id"), "parts").alias("part"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "at", "comp")])
    y = rows.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "at", "comp")])
    # what the two can share from their first common shingle on
    most = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    fits = (F.col("x_id") < F.col("y_id")) & (F.col("x_comp") != F.col("y_comp")) & (most * (100 + threshold) >= threshold * (F.col("x_n") + F.col("y_n")))
    pairs = x.join(y, ["token", "part"]).where(fits).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.col("x_comp").alias("ca"), F.col("y_comp").alias("cb"))
    return scratch.stored(pairs.distinct(), f"{folder}/crowd-pairs")


def set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles as sorted uint64 bytes) of the documents whose id is in ``ids``; several
    rows where an id has several texts."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(k)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                s, at = sh.sets(data, offs)
                raw = s.tobytes()
                yield scratch.arrow_batch(schema, id=part.column(0), shingles=pa.array([raw[8 * x:8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi").select("id", "text")
    return rows.mapInArrow(make, "id long, shingles binary").withColumn("h", F.xxhash64("shingles")).dropDuplicates(["id", "h"]).drop("h")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (a, b) with 100 * intersection >= threshold * union, on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                same = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                keep.append(100 * same >= threshold * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    x, y = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def same_document(feats: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the classes of one doc_id that has several texts."""
    several = feats.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).where("lo <> hi").select("doc_id")
    of = feats.where("n > 0").join(several, "doc_id").select("doc_id", *key).distinct().join(classes.select(*key, "rep"), key)
    return of.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, k: int = 4, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    spark = docs.sparkSession
    folder = scratch.new_folder(spark, "lsh-forest")
    feats = scratch.stored(featured(docs, k), f"{folder}/features")
    key = ["key_a", "key_b", "n"]
    classes = feats.where("n > 0 and doc_id is not null").groupBy(*key).agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("s1", "s2", "sig")])
    classes = scratch.stored(classes, f"{folder}/classes")
    pairs, crowds = forest_pairs(classes.select("rep", "n", "s1", "s2", "sig"), folder, threshold)
    crowded = scratch.stored(crowds.select(F.col("rep").alias("id")).distinct(), f"{folder}/crowded")
    any_crowd = not crowded.isEmpty()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(crowded)
    ids = scratch.stored(ids.distinct(), f"{folder}/ids")
    sets = scratch.stored(set_table(docs, ids, k), f"{folder}/sets")
    if any_crowd:
        crowd_sets = scratch.stored(sets.join(crowded, "id", "left_semi"), f"{folder}/crowd-sets")
        counts = slot_counts(crowd_sets, folder)
        pairs = pairs.union(hub_pairs(crowds, crowd_sets, counts, folder, threshold))
    pairs = scratch.stored(pairs.distinct(), f"{folder}/pairs")
    # first every class with its nearest smaller candidate
    nearest = pairs.groupBy("b").agg(F.min(F.struct("diff", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    first = scratch.stored(confirmed(nearest, sets, threshold), f"{folder}/first")
    roots = components(first.union(same_document(feats, classes, key)), f"{folder}/cc1")
    # then what lies between different components
    ra, rb = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    rest = pairs.join(nearest, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left") \
                .withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b")).where("ra <> rb")
    rest = scratch.stored(rest.select("a", "b", "ra", "rb"), f"{folder}/rest")
    second = confirmed(rest, sets, threshold).join(rest, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    over = components(second, f"{folder}/cc2")
    top = classes.select(*key, "rep").join(roots.toDF("rep", "r1"), "rep", "left").withColumn("r1", F.coalesce("r1", "rep")) \
                 .join(over.toDF("r1", "r2"), "r1", "left").select(*key, "rep", F.coalesce("r2", "r1").alias("component"))
    top = scratch.stored(top, f"{folder}/top")
    if any_crowd:  # and all that crowds may have left between different components
        more = crowd_pairs(crowd_sets, top.select(F.col("rep").alias("id"), F.col("component").alias("comp")), counts, folder, threshold)
        third = confirmed(more, crowd_sets, threshold).join(more, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        last = components(third, f"{folder}/cc3")
        top = scratch.stored(top.join(last.toDF("component", "r3"), "component", "left").select(*key, F.coalesce("r3", "component").alias("component")), f"{folder}/top3")
    top = top.select(*key, "component")
    own = feats.select("doc_id", *key).join(top, key, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents that stay (all columns): the smallest doc_id of each group."""
    gone = near_duplicates(docs, k, threshold).where("not kept").select("doc_id").distinct()
    gone = scratch.stored(gone, scratch.new_folder(docs.sparkSession, "lsh-forest-gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, "doc_id", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: groups of the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
