"""Fill-in-the-middle transformation over a wavelet matrix (operator 13).

A text's units are runs of A-Z and a-z, and every other code point by itself.
Each code point gets a class: inside a run, opening a run, other ASCII, beyond
ASCII. A wavelet matrix over the classes of a whole chunk of texts answers how
often a class stands in any range; the ranks of the three classes that open a
unit add up to the number of units, and bisection on that sum finds the place
of a cut, for all texts of the chunk at once (:mod:`weft.llm.wavelet`).

The first four 8-digit groups h1 to h4 of the hexadecimal SHA-256 of
``<seed>:<doc_id>`` fix the cuts and the form: the prefix ends after the smaller
of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger. The
text stays plain if ``h3 % 100 >= rate``, else it is written suffix first (spm) if
``h4 % 100 < spm``, else prefix first (psm).

Edge cases: a null text is empty; an empty text, and one that contains a marker
``<P>``, ``<S>`` or ``<M>``, stays plain, so that every output can be read back; a
null doc_id is hashed as no digits; rows of one doc_id are cut alike; texts of any
length are taken whole (memory grows with the longest text, about 20 bytes a byte
of it); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import scratch
from weft.llm.textops import text_chunks
from weft.llm.wavelet import WaveletMatrix

INSIDE, OPENS, ASCII, BEYOND = 0, 1, 2, 3
MARKER = "<[PSM]>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                   ("middle_chars", pa.int64()), ("output", pa.string())])


class Units:
    """The units of a chunk of texts: counts and cuts by rank queries."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        """``data``: the texts' UTF-8 bytes; ``offs``: where each text begins, and the end."""
        self.byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each code point
        self.at = np.searchsorted(self.byte, offs)
        lead = data[self.byte[:-1]]
        letter = ((lead | 32) >= 97) & ((lead | 32) <= 122)
        opens = letter.copy()
        opens[1:] &= ~letter[:-1]
        first = self.at[:-1][self.at[:-1] < self.at[1:]]
        opens[first] = letter[first]
        self.classes = WaveletMatrix(np.where(letter, np.where(opens, OPENS, INSIDE), np.where(lead < 128, ASCII, BEYOND)).astype(np.uint8), 2)

    def count(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Units that begin in each range of code points."""
        return sum(self.classes.count(c, start, end) for c in (OPENS, ASCII, BEYOND))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The code point before which each text has ``units`` whole units: the first one
        with more units begun up to it, the text's end if it has no more."""
        start = self.at[:-1]
        low, high = start.copy(), self.at[1:].copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            past = self.count(start, np.minimum(mid + 1, self.at[1:])) > units
            high = np.where(open_ & past, mid, high)
            low = np.where(open_ & ~past, mid + 1, low)
        return low


def drawn(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """Per row: doc_id, units, form, code points of prefix and middle (null if plain), output."""
    scratch.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *drawn(F.col("doc_id").cast("long"), seed))
    marker = re.compile(MARKER.encode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in text_chunks(batch):
                u = Units(data, offs)
                n = u.count(u.at[:-1], u.at[1:])
                h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
                a, b = u.cut(np.minimum(h1 % (n + 1), h2 % (n + 1))), u.cut(np.maximum(h1 % (n + 1), h2 % (n + 1)))
                raw = data.tobytes()
                form, out = [], []
                for i, (x, y, p, q) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), u.byte[a].tolist(), u.byte[b].tolist())):
                    if x == y or h3[i] % 100 >= rate or marker.search(raw, x, y):
                        form.append("plain")
                        out.append(raw[x:y].decode())
                        continue
                    prefix, middle, suffix = raw[x:p], raw[p:q], raw[q:y]
                    form.append("spm" if h4[i] % 100 < spm else "psm")
                    parts = (b"<S>", suffix, b"<P>", prefix) if form[-1] == "spm" else (b"<P>", prefix, b"<S>", suffix)
                    out.append(b"".join((*parts, b"<M>", middle)).decode())
                plain = np.array(form) == "plain"
                yield scratch.arrow_batch(ARROW, doc_id=part.column("doc_id"), n=n, form=pa.array(form),
                                          prefix_chars=pa.array(a - u.at[:-1], mask=plain), middle_chars=pa.array(b - a, mask=plain),
                                          output=pa.array(out, pa.string()))

    return rows.mapInArrow(write, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    part = F.split(output, MARKER)
    return F.when(form == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))) \
            .when(form == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the whole table."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || doc_id) AS s FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || s[1:8])::UBIGINT AS h1, ('0x' || s[9:16])::UBIGINT AS h2,
         ('0x' || s[17:24])::UBIGINT AS h3, ('0x' || s[25:32])::UBIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS a, greatest(h1 % (n + 1)::UBIGINT, h2 % (n + 1)::UBIGINT)::BIGINT AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
