"""Toxicity scores by non-negative positive-unlabelled learning (operator 8).

Confirmed toxic documents are the positives; other text, whatever it is, is
unlabelled. With class prior pi and a margin loss l, the risk of a classifier f
is estimated from these two alone as

    pi * mean_P l(f) + max(0, mean_U l(-f) - pi * mean_P l(-f)),

the second term being the negative class's risk, which can't be negative: where
it falls below zero in a step, the step goes against it instead. f is linear on
the presence of hashed words and word beginnings (3 to 6 bytes), l the sigmoid
loss, training is by Adam with a soft threshold (so most weights are exactly 0).

The prior covers all labelled training rows. What is bounded: the classifier is
fitted on about ``positives`` toxic and ``unlabelled`` other documents, drawn by
a hash of doc_id, of about ``sample_bytes`` of text each (fewer where texts are
long; none longer than that); the driver holds their feature hashes, at most 20
bytes per word, and nothing else.

Edge cases: a null or empty text has no feature and gets the score of the bias;
without any toxic label all scores are 0; a document labelled twice is toxic if
any label says so; repeated rows get the same score; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.textops import WordHasher, text_chunks

POSITIVES, UNLABELLED, SAMPLE_BYTES = 2000, 6000, 32 << 20
U32 = np.uint32


class WordFeatures:
    """32-bit hashes of the words of a chunk and of their beginnings."""

    def __init__(self):
        self.hasher = WordHasher(lower=True)
        for b in range(128):
            self.hasher.space[b] = not chr(b).isalnum()

    def all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of every word and beginning, not ordered, with repeats."""
        starts, ends, at = self.hasher.words(data, offs)
        doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(at))
        docs, feats = [doc], [self.hasher.hashes(data, starts, ends)]
        for k in (3, 4, 5, 6):
            long = np.flatnonzero(ends - starts > k)
            docs.append(doc[long])
            feats.append(self.hasher.hashes(data, starts[long], starts[long] + k) ^ np.uint64(k << 50))
        return np.concatenate(docs), (np.concatenate(feats) >> np.uint64(24)).astype(U32)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 400,
             rate: float = 0.05, l1: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from lists of distinct feature hashes per document."""
    # features seen in enough positives, and oftener there than elsewhere
    fp, np_ = np.unique(np.concatenate(pos), return_counts=True) if pos else (np.zeros(0, U32), np.zeros(0, int))
    seen = np_ >= max(3, 0.002 * len(pos))
    fp, np_ = fp[seen], np_[seen]
    fu, nu = np.unique(np.concatenate(unl), return_counts=True) if unl else (np.zeros(0, U32), np.zeros(0, int))
    at = np.minimum(np.searchsorted(fu, fp), max(len(fu) - 1, 0))
    also = np.where(fu[at] == fp, nu[at], 0) if len(fu) else np.zeros(len(fp))
    names = fp[np_ / max(len(pos), 1) > 1.5 * also / max(len(unl), 1)]

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
        for i, d in enumerate(docs):
            c = np.searchsorted(names, d)
            c = c[(c < len(names))]
            c = c[np.isin(names[c], d)]
            rows.append(np.full(len(c), i))
            cols.append(np.unique(c))
            rows[-1] = rows[-1][:len(cols[-1])]
        return np.concatenate(rows), np.concatenate(cols)

    (rp, cp), (ru, cu) = matrix(pos), matrix(unl)
    w, b = np.zeros(len(names)), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    n_p, n_u = max(len(pos), 1), max(len(unl), 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        f_p = np.bincount(rp, w[cp], len(pos)) + b
        f_u = np.bincount(ru, w[cu], len(unl)) + b
        s_p, s_u = sig(f_p), sig(f_u)         # loss of calling it positive: sig(-f); negative: sig(f)
        d_p, d_u = s_p * (1 - s_p), s_u * (1 - s_u)
        negative = s_u.mean() - prior * s_p.mean() if len(unl) else 0.0
        if negative >= 0:
            g_p, g_u = -2 * prior * d_p / n_p, d_u / n_u
        else:                                  # go back on the part that was fitted too far
            g_p, g_u = prior * d_p / n_p, -d_u / n_u
        g = np.append(np.bincount(cp, g_p[rp], len(names)) + np.bincount(cu, g_u[ru], len(names)), g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(v[:-1] / (1 - 0.99 ** t)) + 1e-6), 0)
    own = w != 0
    return names[own], w[own], float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
          sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """Model from the rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) given."""
    scratch.bounded_batches(docs.sparkSession)
    lab = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = lab.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).collect()[0]
    if not n["p"]:
        return None
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, room = docs.agg(F.count("*"), F.coalesce(F.avg(size), F.lit(0.0))).first()
    room = sample_bytes / max(room, 1.0)  # documents of the mean length
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    chosen = lab.where("toxic = 1").where(unit < min(1.0, min(positives, room) / n["p"])).select("doc_id", F.lit(1).alias("positive"))
    # about `positives` rows by construction
    rows = docs.join(F.broadcast(chosen), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(0)))
    rows = rows.where((F.col("positive") == 1) | (unit < min(1.0, min(unlabelled, room) / max(total, 1)))).where(size <= sample_bytes).select("text", "positive")
    schema = pa.schema([("positive", pa.int32()), ("features", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                doc, feat = words.all(data, offs)
                both = np.unique(doc.astype(np.uint64) << np.uint64(32) | feat)
                at = np.searchsorted(both >> np.uint64(32), np.arange(len(offs), dtype=np.uint64))
                raw = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield scratch.arrow_batch(schema, positive=part.column(1), features=pa.array(
                    [raw[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))

    got = rows.mapInArrow(make, "positive int, features binary").orderBy("positive", "features").collect()
    sets = {k: [np.frombuffer(r["features"], "<u4") for r in got if r["positive"] == k] for k in (0, 1)}
    names, w, b = fit_nnpu(sets[1], sets[0], min(0.5, n["p"] / n["n"]))
    return {"names": names, "w": w, "b": b}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures()
        maybe = np.zeros(1 << 22, bool)
        if model:
            maybe[model["names"] & U32((1 << 22) - 1)] = True
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                s = np.zeros(len(offs) - 1)
                if model:
                    f = np.full(len(s), model["b"])
                    doc, feat = words.all(data, offs)
                    some = np.flatnonzero(maybe[feat & U32((1 << 22) - 1)])
                    both = np.unique(doc[some].astype(np.uint64) << np.uint64(32) | feat[some])
                    doc, feat = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(U32)
                    at = np.searchsorted(model["names"], feat)
                    own = np.flatnonzero(model["names"][np.minimum(at, len(model["names"]) - 1)] == feat) if len(model["names"]) else []
                    if len(own):
                        f += np.bincount(doc[own], model["w"][at[own]], len(s))
                    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
                yield scratch.arrow_batch(schema, doc_id=part.column(0), score=s)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: learn from four fifths of the rows, score all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = ~held_out(F.col("doc_id"))
    model = train(docs.where(seen), labels.where(seen))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
