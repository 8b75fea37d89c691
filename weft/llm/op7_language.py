"""Language identification (operator 7).

A sparse multinomial logistic regression on TF-IDF character n-grams of one to
three code points, hashed into ``DIM`` features; trained by follow-the-
regularised-leader (proximal, per coordinate) with an elastic net; its scores
are calibrated by one temperature, fitted on a part of the sample that the
training did not see.

What covers all training rows: the languages, their counts and the document
frequencies. What is bounded: the classifier is fitted on about ``sample``
documents of about ``sample_bytes`` of text (equal shares by language, drawn by a
hash of doc_id; longer ones than a language's share of the bytes are not drawn),
each a sparse vector of at most three features a character; so the driver holds
at most about 24 bytes per byte of the sample and a weight table of ``DIM`` x
languages.

Texts are lowered by a table of single letters, digits count as one digit, and
white space as one space. Edge cases: a null text, and one without any letter,
are ``und`` with score 0; without training rows all are; rows with a null lang
are not learned from; a tie goes to the language first in order; repeated rows
get the same answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.textops import text_chunks

DIM, ORDERS, SAMPLE, SAMPLE_BYTES = 1 << 16, (1, 2, 3), 8000, 32 << 20
U32 = np.uint32


class CharGrams:
    """Hashed character n-gram counts of the documents of a chunk."""

    def __init__(self):
        self.fold = np.arange(0x2500, dtype=U32)
        for i in range(0x2500):
            low = chr(i).lower()
            self.fold[i] = ord(low) if len(low) == 1 else i
        self.fold[48:58] = 48
        self.fold[[9, 10, 11, 12, 13]] = 32

    def features(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature ids, counts) of each document."""
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = lead[offs]
        cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        cp = np.where(cp < len(self.fold), self.fold[np.minimum(cp, len(self.fold) - 1)], cp).astype(U32)
        codes = []
        for k in ORDERS:
            h = np.full(max(len(cp) - k + 1, 0), U32(k * 0x9E3779B1 & 0xFFFFFFFF), U32)
            for i in range(k):
                h = (h ^ cp[i:len(cp) - k + 1 + i]) * U32(0x85EBCA6B)
                h ^= h >> U32(13)
            codes.append(((h * U32(0xC2B2AE35)) >> U32(16)).astype(np.int32) & (DIM - 1))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.concatenate([c[a:max(a, b - k + 1)] for k, c in zip(ORDERS, codes)])
            if len(own) < 4000:
                yield np.unique(own, return_counts=True)
            else:
                n = np.bincount(own, minlength=DIM)
                idx = np.flatnonzero(n)
                yield idx, n[idx]


def tfidf(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[idx]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


# --- fitting (on the bounded sample) ------------------------------------------

def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 4,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (DIM + 1 x classes); the last feature is the bias."""
    z = np.zeros((DIM + 1, n_classes))
    n = np.zeros((DIM + 1, n_classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            idx, x, y = rows[r]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g2
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least mean log loss (golden section on its logarithm)."""
    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()) + 1e-4 * t * t
    lo, hi, r = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """Model from rows (doc_id, text, lang), all of which may be learned from."""
    rows = docs.where("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).collect()  # a row per language
    if not found:
        return None
    counts = {r["lang"]: r["n"] for r in found}
    langs = sorted(counts)
    quota, room = -(-sample // len(langs)), sample_bytes / len(langs)
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, quota / r["n"], room / max(r["b"], 1))))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.select("text", "lang", ((unit < share[F.col("lang")]) & (F.octet_length("text") <= F.lit(room))).alias("chosen"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("aside"))
    schema = pa.schema([("feature", pa.int32()), ("df", pa.int64()), ("lang", pa.string()), ("aside", pa.bool_()), ("idx", pa.binary()), ("tf", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df = CharGrams(), np.zeros(DIM, np.int64)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                pick = part.column(2).to_pylist()
                out = []
                for i, (idx, n) in enumerate(grams.features(data, offs)):
                    df[idx] += 1
                    if pick[i]:
                        out.append(dict(lang=part.column(1)[i].as_py(), aside=part.column(3)[i].as_py(),
                                        idx=idx.astype("<i4").tobytes(), tf=n.astype("<i4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": some.astype(np.int32), "df": df[some], **{c: [None] * len(some) for c in schema.names[2:]}}, schema=schema)

    folder = scratch.new_folder(docs.sparkSession, "language")
    made = scratch.stored(chosen.mapInArrow(count, "feature int, df long, lang string, aside boolean, idx binary, tf binary"), f"{folder}/made")
    df = np.zeros(DIM)
    for r in made.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).collect():  # at most DIM rows
        df[r["feature"]] = r["df"]
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    got = made.where("lang is not null").select("lang", "aside", "idx", "tf").orderBy("lang", "aside", "idx", "tf").collect()  # about `sample` rows
    fit, aside = [], []
    for r in got:
        idx = np.frombuffer(r["idx"], "<i4")
        x = np.append(tfidf(idx, np.frombuffer(r["tf"], "<i4"), idf), 0.1)
        (aside if r["aside"] else fit).append((np.append(idx, DIM), x, langs.index(r["lang"])))
    w = fit_ftrl(fit, len(langs))
    t = fit_temperature(np.array([x @ w[i] for i, x, _ in aside]), np.array([y for *_, y in aside])) if aside else 1.0
    return {"langs": langs, "idf": idf.astype(np.float32), "w": (w / t).astype(np.float32), "temperature": t}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = CharGrams()
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                raw, lang, score = data.tobytes(), [], []
                for i, (idx, n) in enumerate(grams.features(data, offs)):
                    if model is None or not any(map(str.isalpha, raw[offs[i]:offs[i + 1]].decode("utf-8", "replace"))):
                        lang.append("und")
                        score.append(0.0)
                        continue
                    s = tfidf(idx, n, model["idf"]) @ model["w"][idx] + 0.1 * model["w"][DIM]
                    p = np.exp(s - s.max(), dtype=np.float64)
                    p /= p.sum()
                    best = int(p.argmax())
                    lang.append(model["langs"][best])
                    score.append(float(p[best]))
                yield scratch.arrow_batch(schema, doc_id=part.column(0), lang_pred=pa.array(lang, pa.string()), score=np.array(score, np.float64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: learn from three quarters of the table, predict all of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
