"""A table's vectors as block files in the shared folder, for tasks to read one
block at a time.

Each task writes its rows in Arrow files of at most ``size`` vectors under names
of its own and returns them; only the files a committed manifest names are
read, so a repeated task leaves at most unread files. Nothing passes the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import scratch_path


def matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def write_blocks(vectors: DataFrame, key: str, vec: str, size: int) -> str:
    """Write (key, vec) in blocks; the folder to give to :func:`read_blocks`."""
    folder = scratch_path(vectors.sparkSession, f"blocks/{uuid.uuid4().hex[:12]}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(f"{path}/data", recursive=True)
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                name = f"{uuid.uuid4().hex}.arrow"
                rows = np.ascontiguousarray(matrix(part.column(1)))
                raw = pa.array([r.tobytes() for r in rows], pa.binary())
                one = pa.RecordBatch.from_arrays([part.column(0), raw], names=["key", "vec"])
                with fs.open_output_stream(f"{path}/data/{name}") as out, pa.ipc.new_file(out, one.schema) as w:
                    w.write_batch(one)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part.num_rows], pa.int64())], names=["name", "n"])

    vectors.select(key, vec).where(F.col(vec).isNotNull()).mapInArrow(write, "name string, n long").write.parquet(f"{folder}/manifest")
    return folder


class Blocks:
    """The blocks of a folder, opened in a task."""

    def __init__(self, folder: str):
        remote = "://" in folder or folder.startswith("file:")
        self.fs, self.path = pafs.FileSystem.from_uri(folder) if remote else (pafs.LocalFileSystem(), folder)
        listed = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/manifest"))
        parts = sorted(i.path for i in listed if i.base_name.startswith("part-"))
        self.names = [n for p in parts for n in pq.read_table(p, filesystem=self.fs).column("name").to_pylist()]

    def __iter__(self) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(number, keys, float64 matrix) of each block."""
        for i, name in enumerate(self.names):
            with self.fs.open_input_file(f"{self.path}/data/{name}") as f:
                b = pa.ipc.open_file(f).get_batch(0)
                vec = b.column(1)
                rows = np.frombuffer(b"".join(x.as_py() for x in vec), np.float64).reshape(len(vec), -1)
                yield i, b.column(0), rows
