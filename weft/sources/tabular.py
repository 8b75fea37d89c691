"""Reading tabular files with an explicit schema and converting
between formats."""

from __future__ import annotations

from typing import Sequence

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.session import scratch_path

def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once under the shared folder and read it back, so that
    several readers share one computation."""
    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FORMATS = ("json", "csv", "parquet", "orc", "text")


def read_tabular(spark: SparkSession, fmt: str, path: str, schema=None,
                 options: dict | None = None) -> DataFrame:
    """``json`` / ``csv`` / ``parquet`` / ``orc`` / ``text`` with an explicit
    schema (no inference pass over the data); ``jdbc`` takes its options
    (url, dbtable, partitionColumn, lowerBound, upperBound, numPartitions)
    so the read is split into parallel range queries."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path) if fmt != "jdbc" else r.load()


def convert_format(spark: SparkSession, src_fmt: str, src: str, dst_fmt: str, dst: str,
                   schema=None, partition_by: Sequence[str] = (), mode: str = "overwrite",
                   options: dict | None = None) -> None:
    """Read one format and write another, optionally partitioned."""
    df = read_tabular(spark, src_fmt, src, schema, options)
    w = df.write.mode(mode).format(dst_fmt)
    if dst_fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(dst)
