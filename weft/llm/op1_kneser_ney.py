"""Interpolated modified Kneser-Ney language model and text scores (operator 1).

The model is a bigram model over words and one end token a text, which is also
the context of a text's first token. Counting is a Spark job; the result is
three kinds of sorted array files in the shared folder, which the scoring tasks
memory-map and search by vector operations:

``*.voc``  sorted 64-bit word hashes of one hash range, and their counts; a
           word's id is its place among all of them;
``*.big``  sorted 64-bit bigram keys (id of the context, id of the word) of one
           bucket of key hashes, and their counts;
``*.ctx``  for the ids of one ``voc`` file: total of the context, its back-off
           weight, and the word's continuation count.

Buckets are as many as the session's shuffle partitions (a power of two), cut by
hash, so that a frequent word's bigrams spread over all of them; what a task
holds is its share of the distinct keys. Tasks count their partition first and
send sorted, delta-coded blocks.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * p(w)
    p(w)     = max(t(w) - D'(t(w)), 0) / T + g' / (V + 1)

t(w) is the number of distinct contexts of w, T their sum; D(1), D(2), D(3+)
come from the counts of counts, on each level its own; g are the weights the
discounts leave, and the rest of the last level is shared by all V words and
one unknown.

Edge cases: a null or empty text is the end token alone; a null doc_id is
learned from; with nothing to learn from every score is 0; repeated rows count
again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.textops import WordHasher, mix, text_chunks

U = np.uint64
END = U(0x1F83D9ABFB41BD6B)
FLUSH = 3_000_000  # keys a task holds before it sends


# --- counting helpers -----------------------------------------------------------

def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts as bytes: differences, byte planes, zstd."""
    delta = np.diff(keys, prepend=U(0))
    raw = delta.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.decompress(block[8:], 16 * n, codec="zstd", asbytes=True), np.uint8)
    back = lambda x: np.ascontiguousarray(x.reshape(8, n).T).view(U).reshape(n)
    return np.cumsum(back(raw[:8 * n]), dtype=U), back(raw[8 * n:])


class Counts:
    """Distinct keys of a task with their counts, sent when they get many."""

    def __init__(self, bits: int, mixed: bool):
        self.bits, self.mixed, self.parts, self.waiting = bits, mixed, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.parts.append(merge(keys, np.ones(len(keys), U)))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > FLUSH:
            self.parts = [merge(*map(np.concatenate, zip(*self.parts)))]
            self.waiting = len(self.parts[0][0])
            if self.waiting > FLUSH // 2:
                yield from self.send()

    def send(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            keys, counts = merge(*map(np.concatenate, zip(*self.parts)))
            bucket = bucket_of(mix(keys) if self.mixed else keys, self.bits)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1))
            for b in np.flatnonzero(np.diff(at)).tolist():
                own = order[at[b]:at[b + 1]]
                yield b, pack(keys[own], counts[own])
        self.parts, self.waiting = [], 0


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def discounts(n: list[int]) -> list[float]:
    """D(1), D(2), D(3+) from the numbers of keys counted 1, 2, 3 and 4 times.

    Where a count of counts is 0 the estimate has no value: then 0.5, 1, 1.5."""
    n1, n2, n3, n4 = n
    if not n1 or not n2 or not n3:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def token_hashes(hasher: WordHasher, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end token of each text, and text offsets."""
    starts, ends, at = hasher.words(data, offs)
    return np.insert(hasher.hashes(data, starts, ends), at[1:], END), at + np.arange(len(at))


BLOCKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.binary())])


def _blocks(found: Iterator[tuple[int, bytes]], kind: int = 0) -> Iterator[pa.RecordBatch]:
    for b, block in found:
        yield scratch.arrow_batch(BLOCKS, kind=np.array([kind], np.int32), bucket=np.array([b], np.int32), block=pa.array([block], pa.binary()))


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x.as_py()) for x in table.column("block")]
    return merge(*map(np.concatenate, zip(*parts)))


# --- the files -------------------------------------------------------------------

class Vocabulary:
    """Memory-mapped word hashes and counts; ids run through the files in order."""

    def __init__(self, folder: str, files: list[dict], bits: int):
        self.bits, self.files = bits, {f["bucket"]: f for f in files}
        self.hash = {f["bucket"]: scratch.map_array(f"{folder}/{f['stem']}.voc", "<u8", f["n"], 0) for f in files}
        self.count = {f["bucket"]: scratch.map_array(f"{folder}/{f['stem']}.voc", "<u8", f["n"], 8 * f["n"]) for f in files}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, place in the bucket or -1, count) of sorted distinct hashes."""
        place, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bucket = bucket_of(hashes, self.bits)
        at = np.searchsorted(bucket, np.arange((1 << self.bits) + 1))
        for b, stored in self.hash.items():
            own = hashes[at[b]:at[b + 1]]
            if len(own) and len(stored):
                p = np.minimum(np.searchsorted(stored, own), len(stored) - 1)
                hit = stored[p] == own
                place[at[b]:at[b + 1]] = np.where(hit, p, -1)
                count[at[b]:at[b + 1]] = np.where(hit, self.count[b][p], 0)
        return bucket, place, count

    def ids(self, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
        base = np.zeros(1 << self.bits, np.int64)
        for b, f in self.files.items():
            base[b] = f["base"]
        return np.where(place >= 0, base[bucket] + place, -1)


def train(docs: DataFrame, folder: str) -> dict:
    """Count the texts of ``docs`` and write the model; returns its description
    (totals, discounts and one entry per file)."""
    spark = docs.sparkSession
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    text = docs.select("text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(lower=True), Counts(bits, mixed=False)
        for batch in batches:
            for _, data, offs in text_chunks(batch):
                yield from _blocks(seen.add(token_hashes(hasher, data, offs)[0]))
        yield from _blocks(seen.send())

    def write_words(table: pa.Table) -> pa.Table:
        keys, counts = _gathered(table)
        bucket = table.column("bucket")[0].as_py()
        stem = scratch.attempt_name("words", bucket)
        scratch.write_bytes(f"{folder}/{stem}.voc", keys.astype("<u8"), counts.astype("<u8"))
        return pa.Table.from_pylist([dict(bucket=bucket, stem=stem, n=len(keys), tokens=int(counts.sum()))], schema=pa.schema(
            [("bucket", pa.int32()), ("stem", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())]))

    ddl = "kind int, bucket int, block binary"
    made = scratch.stored(text.mapInArrow(words, ddl).groupBy("bucket").applyInArrow(
        write_words, "bucket int, stem string, n long, tokens long"), f"{folder}/words")
    files, base = [], 0
    for r in made.orderBy("bucket").collect():  # a row per bucket
        files.append({**r.asDict(), "base": base})
        base += r["n"]
    if base >= 1 << 32:
        raise ValueError("more than 2^32 distinct words: bigram keys hold 32 bits a word")
    model = {"folder": folder, "bits": bits, "words": files, "V": base, "N": sum(f["tokens"] for f in files)}

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, voc = WordHasher(lower=True), Counts(bits, mixed=True), Vocabulary(folder, files, bits)
        for batch in batches:
            for _, data, offs in text_chunks(batch):
                h, at = token_hashes(hasher, data, offs)
                key = _keys(*_token_ids(voc, h)[:2], at)[0]
                yield from _blocks(seen.add(key))
        yield from _blocks(seen.send())

    starts = np.array([f["base"] for f in files] or [0])
    schema = pa.schema([*BLOCKS, ("stem", pa.string()), ("n", pa.int64()), *[(f"n{i}", pa.int64()) for i in (1, 2, 3, 4)]])

    def write_bigrams(table: pa.Table) -> pa.Table:
        keys, counts = _gathered(table)
        bucket = table.column("bucket")[0].as_py()
        stem = scratch.attempt_name("bigrams", bucket)
        scratch.write_bytes(f"{folder}/{stem}.big", keys.astype("<u8"), counts.astype("<u8" if counts.max() >> U(32) else "<u4"))
        rows = [dict(kind=-1, bucket=bucket, stem=stem, n=len(keys) if counts.max() >> U(32) == 0 else -len(keys),
                     **{f"n{i}": int((counts == i).sum()) for i in (1, 2, 3, 4)})]
        v, w = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        stats = [np.add.reduceat(x.astype(U), first) for x in (counts, counts == 1, counts == 2, counts > 2)]
        ids, cont = np.unique(w, return_counts=True)
        cut = []
        for own, n in [*((v[first], s) for s in stats), (ids, cont.astype(U))]:
            own, n = own[n > 0], n[n > 0]
            cut.append((own, n, np.searchsorted(own, [*starts, 1 << 32])))  # ids rise, so each file's are a slice
        for r in range(len(starts)):
            parts = [pack(own[at[r]:at[r + 1]].astype(U), n[at[r]:at[r + 1]]) for own, n, at in cut]
            if any(at[r + 1] > at[r] for *_, at in cut):  # all five sums for a file's ids in one block
                rows.append(dict(kind=0, bucket=files[r]["bucket"], block=b"".join(len(x).to_bytes(8, "little") + x for x in parts)))
        return pa.Table.from_pylist(rows, schema=schema)

    made = scratch.stored(text.mapInArrow(bigrams, ddl).groupBy("bucket").applyInArrow(
        write_bigrams, ddl + ", stem string, n long, n1 long, n2 long, n3 long, n4 long"), f"{folder}/bigrams")
    rows = [r.asDict() for r in made.where("kind = -1").select("bucket", "stem", "n", "n1", "n2", "n3", "n4").collect()]  # a row per bucket
    d = discounts([sum(r[f"n{i}"] for r in rows) for i in (1, 2, 3, 4)])
    model |= {"bigrams": [{k: r[k] for k in ("bucket", "stem", "n")} for r in rows], "D": d}
    sizes = {f["bucket"]: (f["base"], f["n"]) for f in files}
    out = pa.schema([("bucket", pa.int32()), ("stem", pa.string()), ("total", pa.int64()), *[(f"n{i}", pa.int64()) for i in (0, 1, 2, 3, 4)]])

    def write_contexts(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        base, n = sizes[bucket]
        sums = np.zeros((5, n))
        for block in table.column("block"):
            block = block.as_py()
            for total in sums:
                size = int.from_bytes(block[:8], "little")
                ids, x = unpack(block[8:8 + size])
                total[ids.astype(np.int64) - base] += x
                block = block[8 + size:]
        weight = (d[0] * sums[1] + d[1] * sums[2] + d[2] * sums[3]) / np.maximum(sums[0], 1)
        stem = scratch.attempt_name("contexts", bucket)
        scratch.write_bytes(f"{folder}/{stem}.ctx", *[x.astype("<f4") for x in (sums[0], weight, sums[4])])
        c = sums[4]
        return pa.Table.from_pylist([dict(bucket=bucket, stem=stem, total=int(c.sum()), n0=int((c > 0).sum()),
                                          **{f"n{i}": int((c == i).sum()) for i in (1, 2, 3, 4)})], schema=out)

    made = scratch.stored(made.where("kind >= 0").select("kind", "bucket", "block").groupBy("bucket").applyInArrow(
        write_contexts, "bucket int, stem string, total long, n0 long, n1 long, n2 long, n3 long, n4 long"), f"{folder}/contexts")
    rows = [r.asDict() for r in made.collect()]  # a row per bucket
    n = [sum(r[f"n{i}"] for r in rows) for i in (0, 1, 2, 3, 4)]
    total, low = sum(r["total"] for r in rows), discounts(n[1:])
    rest = (low[0] * n[1] + low[1] * n[2] + low[2] * (n[0] - n[1] - n[2])) / total if total else 1.0
    return model | {"contexts": {r["bucket"]: r["stem"] for r in rows}, "D_low": low, "T": total, "rest": rest}


# --- looking up ---------------------------------------------------------------------

def _token_ids(voc: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of each token or -1, id of the end token or -1, place among the
    distinct hashes, and their bucket, place and count)."""
    uniq, inv = np.unique(np.append(h, END), return_inverse=True)
    bucket, place, count = voc.find(uniq)
    ids = voc.ids(bucket, place)[inv]
    return ids[:-1], int(ids[-1]), inv[:-1], bucket, place, count


def _keys(ids: np.ndarray, end: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram key, context id) of each token; a text's first token follows the end token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1]] = end
    return before.astype(U) << U(32) | ids.astype(U) & U(0xFFFFFFFF), before


class Model:
    """The model's files, memory-mapped, and vector lookups over them."""

    def __init__(self, m: dict):
        self.m = m
        f = m["folder"]
        self.voc = Vocabulary(f, m["words"], m["bits"])
        self.big = {}
        for x in m["bigrams"]:
            n, kind = abs(x["n"]), "<u4" if x["n"] > 0 else "<u8"
            uri = f"{f}/{x['stem']}.big"
            self.big[x["bucket"]] = scratch.map_array(uri, "<u8", n, 0), scratch.map_array(uri, kind, n, 8 * n)
        self.ctx = {}
        for x in m["words"]:
            uri, n = f"{f}/{m['contexts'][x['bucket']]}.ctx", x["n"]
            self.ctx[x["bucket"]] = [scratch.map_array(uri, "<f4", n, 4 * i * n) for i in range(3)]

    def _context(self, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(total, weight, continuation) rows of distinct words in hash order; zeros if unknown."""
        out = np.zeros((3, len(place)))
        at = np.searchsorted(bucket, np.arange((1 << self.m["bits"]) + 1))
        for b, arrays in self.ctx.items():
            own = slice(at[b], at[b + 1])
            p = place[own]
            for row, x in zip(out, arrays):
                row[own][p >= 0] = x[p[p >= 0]]
        return out

    def _bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        uniq, inv = np.unique(keys, return_inverse=True)
        bucket = bucket_of(mix(uniq), self.m["bits"])
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange((1 << self.m["bits"]) + 1))
        out = np.zeros(len(uniq), np.int64)
        for b, (stored, counts) in self.big.items():
            own = order[at[b]:at[b + 1]]
            if len(own):
                p = np.minimum(np.searchsorted(stored, uniq[own]), len(stored) - 1)
                out[own] = np.where(stored[p] == uniq[own], counts[p], 0)
        return out[inv]

    def score(self, h: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and model score."""
        m = self.m
        ids, end, inv, bucket, place, count = _token_ids(self.voc, h)
        keys, before = _keys(ids, end, at)
        ctx = self._context(bucket, place)
        low = np.maximum(ctx[2] - discount(ctx[2], m["D_low"]), 0) / max(m["T"], 1) + m["rest"] / (m["V"] + 1)
        total, weight = ctx[0][inv], ctx[1][inv]
        pair = np.zeros(len(ids), np.int64)
        both = np.flatnonzero((ids >= 0) & (before >= 0))
        pair[both] = self._bigram_counts(keys[both])
        # the context of a token is the token before it, or the end token
        place_end = np.searchsorted(np.unique(np.append(h, END)), END)
        t, g = np.empty(len(ids)), np.empty(len(ids))
        t[1:], g[1:] = total[:-1], weight[:-1]
        t[at[:-1]], g[at[:-1]] = ctx[0][place_end], ctx[1][place_end]
        p = np.where(t > 0, np.maximum(pair - discount(pair, m["D"]), 0) / np.maximum(t, 1) + g * low[inv], low[inv])
        base = np.log10((count + 1) / (m["N"] + m["V"] + 1))[inv]
        add = lambda x: np.add.reduceat(x, at[:-1])
        return {"n_tokens": np.diff(at), "n_known": add((count[inv] > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Scores and perplexity of every text of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lm = WordHasher(lower=True), Model(model)
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                x = lm.score(*token_hashes(hasher, data, offs))
                yield scratch.arrow_batch(schema, doc_id=part.column(0), perplexity=10 ** (-x["score"] / x["n_tokens"]), **x)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: learn from six sevenths of the table, score all of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), scratch.new_folder(spark, "kneser-ney"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
