"""SparkSession construction and the few settings every plan relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume. AQE re-plans joins and coalesces small
# shuffle partitions at runtime; skew-join splitting covers hot join keys.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # reliable checkpoints written by a plan are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "weft",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`BASE_CONF` applied.

    ``master`` is only set for local runs; on a cluster it comes from
    spark-submit. The checkpoint directory is taken from the session when
    the cluster names one and only falls back to a scratch folder otherwise.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem folder;
    it is read, never overridden, and a cluster without it is an error (a
    machine-local folder would not survive a lost executor). Only in local
    mode (tests, the bench) does an unset folder fall back to a scratch one.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store); "
                               "checkpoints and stream state are written there")
        current = tempfile.mkdtemp(prefix="weft-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables/state."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def local_session(cores: int | None = None) -> SparkSession:
    """Session for tests and the bench: ``local[N]`` with N shuffle partitions."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(master=f"local[{n}]", shuffle_partitions=n, extra={
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(n),
    })
