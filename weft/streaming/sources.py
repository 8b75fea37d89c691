"""Streaming sources and the batch-partitioned sink used by the stream twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import scratch_path
from weft.sources.tables import load, table_path


def table_stream(spark: SparkSession, folder: str, name: str | None = None,
                 schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder with an explicit schema; each new
    file is picked up once. With ``name``, the table ``<folder>/<name>.parquet``
    is streamed, be it one file or a folder of part files."""
    if schema is None:
        schema = load(spark, folder, name).schema if name else spark.read.parquet(folder).schema
    r = spark.readStream.schema(schema)
    if name and is_folder(spark, table_path(folder, name)):
        folder = table_path(folder, name)
    elif name:
        r = r.option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path (on any file system Spark reads) is a folder."""
    fs, p = _file_system(spark, path)
    return bool(fs.getFileStatus(p).isDirectory())


def finish(q, timeout_s: int | None) -> None:
    """Wait for a query to end. A failed query raises its error; one that is
    not done in time is stopped and raises, so that its partial output is
    never taken for the whole."""
    done = q.awaitTermination(timeout_s)
    if timeout_s is not None and not done:
        q.stop()
        raise TimeoutError(f"stream not finished after {timeout_s} s; stopped")
    if q.exception() is not None:
        raise q.exception()


def with_event_time(df: DataFrame, col: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Cast a TIMESTAMP_NTZ column to TIMESTAMP (session zone UTC) and set
    the watermark on it."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, delay)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_state_store(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store provider; set it
    when the session still has the default provider."""
    cur = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""
    if "RocksDB" not in cur:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_batches(df: DataFrame, name: str, output_mode: str = "append",
                base: str | None = None, available_now: bool = True,
                timeout_s: int | None = None) -> str:
    """Run a streaming query to completion, writing every micro-batch to
    ``<base>/out/batch_id=<id>`` (overwrite of that one partition, so a
    replayed batch after a failure rewrites the same files). Returns the
    output folder. ``base`` defaults to a fresh folder under the shared
    checkpoint directory."""
    spark = df.sparkSession
    ensure_state_store(spark)
    own = base is None
    base = base or scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    out = f"{base}/out"
    # an empty partition first: a stream without rows reads back as no rows
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", f"{base}/checkpoint"))
    w = w.trigger(availableNow=True) if available_now else w
    finish(w.start(), timeout_s)
    if own and available_now:  # a run of its own: its state and offsets serve nothing any more
        fs, p = _file_system(spark, f"{base}/checkpoint")
        fs.delete(p, True)
    return out


def run_observers(df: DataFrame, observers: dict, name: str, base: str | None = None,
                  errors: dict | None = None, timeout_s: int | None = None) -> str:
    """Run a stream to completion handing every micro-batch to each
    observer ``fn(batch, batch_id, folder)`` (persisted once, failures
    isolated and counted in ``errors``). Each observer gets its own output
    folder under the returned base folder."""
    from weft.streaming.queries import fan_out
    spark = df.sparkSession
    ensure_state_store(spark)
    base = base or scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    bound = {k: (lambda fn, k: (lambda b, i: fn(b, i, f"{base}/{k}")))(fn, k)
             for k, fn in observers.items()}
    q = (df.writeStream.foreachBatch(fan_out(bound, errors))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    finish(q, timeout_s)
    return base


def read_batches(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All rows written by :func:`run_batches`, with ``batch_id``."""
    return spark.read.schema(schema + ", batch_id int").parquet(out)


def latest_per_key(df: DataFrame, keys, order: str = "batch_id") -> DataFrame:
    """Final value per key from an update-mode output: the row of the last
    batch (a partial aggregate, no window)."""
    cols = [c for c in df.columns if c not in keys and c != order]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__v"))
            .select(*keys, "__v.*"))


def kafka_event_stream(spark: SparkSession, servers: str, topic: str, schema,
                       starting_offsets: str = "earliest",
                       max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S4 on Kafka: JSON event values parsed with an explicit schema; the
    Kafka offset (per partition) is kept as ``kafka_offset``. Needs the
    spark-sql-kafka package on the classpath (not bundled here; untested)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    raw = r.load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"),
                      F.col("partition").alias("kafka_partition"),
                      F.col("offset").alias("kafka_offset")).select("e.*", "kafka_partition",
                                                                    "kafka_offset")
