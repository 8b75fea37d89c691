"""Appends that leave each row once, however often they are tried.

A batch of rows is appended under a token its caller names (a batch number, a
source file, a date). Its files go to a folder of this attempt alone; then one
small file named after the token commits the attempt, by a rename that fails if
the token is committed already. Readers take the folders the commits name, so
the files of a broken attempt, or of a second one under the same token, are never
read. Several writers may append at the same time.

Layout of a table: ``<path>/_appends/_attempt=<name>/...`` and ``<path>/_committed/<token>``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.=-]*")


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = p.getFileSystem(conf).makeQualified(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf), p.getFileSystem(conf), p


def is_committed(spark: SparkSession, path: str, token: str) -> bool:
    _, fs, p = _context(spark, f"{path}/_committed/{token}")
    return bool(fs.exists(p))


def append_once(df: DataFrame, path: str, token: str, partition_by: Sequence[str] = ()) -> bool:
    """Append ``df`` under ``token``; False if that token was committed before, by this
    call's caller or another, and nothing was added."""
    if not TOKEN.fullmatch(token):
        raise ValueError(f"a token is letters, digits and _ . = -, not {token!r}")
    spark = df.sparkSession
    if is_committed(spark, path, token):
        return False
    attempt = f"{token}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/_appends/_attempt={attempt}")
    return _commit(spark, path, token, attempt)


def _commit(spark: SparkSession, path: str, token: str, attempt: str) -> bool:
    ctx, fs, target = _context(spark, f"{path}/_committed/{token}")
    _, _, draft = _context(spark, f"{path}/_committed/.{attempt}")
    out = fs.create(draft, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        ctx.rename(draft, target, none)
        return True
    except Exception:  # noqa: BLE001 - lost to another attempt, or a real failure
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(draft, False)
        if fs.exists(target) and _attempt_of(spark, path, token) != attempt:
            fs.delete(_context(spark, f"{path}/_appends/_attempt={attempt}")[2], True)


def _attempt_of(spark: SparkSession, path: str, token: str) -> str:
    return spark.read.text(f"{path}/_committed/{token}").first()[0]


def read_appends(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows; ``schema`` names the partition columns too. Their
    filters still skip whole folders."""
    try:
        names = [r[0] for r in spark.read.text(f"{path}/_committed/*").collect()]
    except AnalysisException:  # nothing was ever committed
        names = []
    if not names:
        return spark.createDataFrame([], schema)
    back = spark.read.schema(schema).option("basePath", f"{path}/_appends").parquet(
        *[f"{path}/_appends/_attempt={n}" for n in sorted(names)])
    return back.drop("_attempt")
