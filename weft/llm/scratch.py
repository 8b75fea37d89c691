"""Files and tables in the shared folder the session names.

Everything an operator writes lies under ``spark.checkpoint.dir``: Parquet
tables written by Spark, and raw array files written by tasks through
``pyarrow.fs``. A task never overwrites: each attempt writes files of its own
name and returns them, and only names in a committed manifest are ever read,
so a lost executor or a second attempt leaves at most an unread file.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs

from pyspark.sql import DataFrame, SparkSession

from weft.session import scratch_path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Texts are of any length, so Arrow batches are cut by bytes, not by rows
    alone. A limit the session names itself stays."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for one run of an operator."""
    bounded_batches(spark)
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it again: cuts the
    lineage, and side effects of its tasks happen once per committed row."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(uri: str) -> list[dict]:
    """The rows of a small table written by :func:`stored`, read inside a task."""
    fs, path = locate(uri)
    parts = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.startswith("part-"))
    return [r for p in parts for r in pq.read_table(p, filesystem=fs).to_pylist()]


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts) -> None:
    """Write buffers one after the other as one file."""
    fs, path = locate(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for p in parts:
            out.write(memoryview(np.ascontiguousarray(p)).cast("B") if isinstance(p, np.ndarray) else p)


def map_array(uri: str, dtype, count: int = -1, offset: int = 0) -> np.ndarray:
    """A file's array without reading it whole: memory-mapped where the folder
    is mounted, otherwise read through the file system's reader."""
    fs, path = locate(uri)
    dtype = np.dtype(dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(path).size - offset
        n = size // dtype.itemsize if count < 0 else count
        return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(n,)) if n else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        size = f.size() - offset
        n = size // dtype.itemsize if count < 0 else count
        return np.frombuffer(f.read_at(n * dtype.itemsize, offset), dtype)


def attempt_name(prefix: str, number: int) -> str:
    """A file stem no other task attempt uses."""
    return f"{prefix}-{number:06d}-{uuid.uuid4().hex[:12]}"


def arrow_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A record batch from arrays (numpy or Arrow) named like ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type)
         for k, c in ((f.name, cols[f.name]) for f in schema)], schema=schema)
