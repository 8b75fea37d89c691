"""Line dedup across documents (operator 12).

A line's key is the line without white space at both ends, with A-Z lower-cased.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines, except in the largest doc_id that holds them.

1. Each document's lines become (place, key hash) pairs, the hash 128 bits wide;
   this compact table is written once, and texts are not read again until the end.
2. The pairs are exploded and made distinct per document, and documents are
   counted per key with map-side partial aggregates, so that a line of a third
   of all documents never meets in one task.
3. Frequent keys meet the pairs again. Of N (document, key) pairs, fewer than
   ``HEAVY`` keys can have more than N / ``HEAVY`` of them: those keys, and no
   others, are broadcast. All others join by shuffle, at most N / ``HEAVY`` rows a key.
4. The places to drop meet the texts by a 128-bit key of (doc_id, text), one
   shuffle of the texts, and the other lines are put together by place.

Edge cases: a null text is empty, and an empty text is one empty line; rows of
one doc_id are one document, whatever their texts; a null doc_id counts as one
document that is smaller than all others; identical rows get the same result
each; a text that loses all its lines is empty; an empty table gives no rows;
other columns are kept by :func:`dedup` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch

MIN_CHARS, MIN_DOCS = 20, 3
HEAVY = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def wide_hash(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the same values from different seeds."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)]


def line_keys(text: Column, min_chars: int) -> Column:
    """(pos, a, b) of the lines whose key is long enough."""
    trimmed = F.transform(lines_of(F.translate(text, UPPER, UPPER.lower())),
                          lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACES)).alias("key")))
    long_ = F.filter(trimmed, lambda x: F.char_length(x["key"]) >= min_chars)

    def hashed(x: Column) -> Column:
        a, b = wide_hash(x["key"])
        return F.struct(x["pos"].alias("pos"), a.alias("a"), b.alias("b"))

    return F.transform(long_, hashed)


def frequent_lines(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, n_docs, keeper) of the keys held by at least ``min_docs`` documents."""
    held = keyed.select("doc", F.explode(F.array_distinct(F.transform("keys", lambda x: F.struct(x["a"], x["b"])))).alias("k"))
    return held.select("doc", "k.a", "k.b").distinct().groupBy("a", "b") \
               .agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)


def places_to_drop(keyed: DataFrame, often: DataFrame) -> DataFrame:
    """(r1, r2, drop): the places of the lines that each row loses."""
    total = often.agg(F.sum("n_docs")).first()[0] or 0
    heavy = F.broadcast(often.where(F.col("n_docs") * HEAVY > total).select("a", "b", "keeper"))
    light = often.where(F.col("n_docs") * HEAVY <= total).select("a", "b", "keeper")
    pairs = keyed.select("r1", "r2", "doc", F.explode("keys").alias("k")).select("r1", "r2", "doc", "k.pos", "k.a", "k.b")
    met = pairs.join(heavy, ["a", "b"]).unionByName(
        pairs.join(heavy, ["a", "b"], "left_anti").join(light.hint("merge"), ["a", "b"]))
    return met.where(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("drop"))


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Each row as ``_row``, with its kept text and the numbers of its lines."""
    folder = scratch.new_folder(docs.sparkSession, "lines")
    r1, r2 = wide_hash(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    keyed = scratch.stored(docs.select(r1.alias("r1"), r2.alias("r2"), F.col("doc_id").cast("long").alias("doc"),
                                       line_keys(F.col("text"), min_chars).alias("keys")).where(F.size("keys") > 0), f"{folder}/keys")
    often = scratch.stored(frequent_lines(keyed, min_docs), f"{folder}/frequent")
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    met = rows.join(places_to_drop(keyed, often).hint("merge"), ["r1", "r2"], "left")
    lines, n = lines_of(F.col("_row.text")), F.size(lines_of(F.col("_row.text")))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "drop"), lambda i: F.get("lines", i))
    return met.select("_row", "drop", lines.alias("lines"), n.cast("long").alias("n_lines")).select(
        "_row", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, other columns as they are."""
    k = _kept(docs, min_chars, min_docs)
    return k.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _kept(docs, MIN_CHARS, MIN_DOCS).select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                                                   F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (
  SELECT doc_id, line, pos, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
