"""Driver contract: entry runs, every query has a builder, oracles are a
subset, and every query builds and runs on the smallest scale."""

import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 70


def test_every_query_runs_small(spark):
    failures = []
    for name, fn in E.queries().items():
        try:
            fn(spark, SF_SMALL).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            failures.append((name, str(e)[:200]))
    assert failures == []


def test_python_workers_run_from_another_directory(tmp_path):
    """Queries whose code runs in Python workers (mapInPandas, keyed state)
    work when the driver's working directory does not contain the package:
    the code travels with the task (pickled by value)."""
    import os
    import subprocess
    import sys
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                         "__spark_entry__.py")
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {entry!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
q = E.queries()
print("RESULT", q["resource_admission"](s, {SF_SMALL!r}).count(),
      q["stream_task_lifecycle"](s, {SF_SMALL!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    a, b = map(int, line[0].split()[1:])
    assert a > 0 and b >= 0


def test_cluster_without_checkpoint_folder_is_an_error():
    """No machine-local fallback outside local mode."""
    import pytest
    from weft.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("must not set a folder on a cluster")

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
