"""T2 with one agent holding nearly all events: folded before the state."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from weft.operators import events as ev
from weft.session import scratch_path
from weft.sources.adapters import Model
from weft.streaming import queries as sq
from weft.streaming import stateful as S
from weft.streaming.sources import latest_per_key, read_batches, run_batches

SCHEMA = "seq long, event_type string, source_agent long, new_state string, task_id long"


def hot_log(n=30_000, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        et, ns = r.choice([("agent_state_changed", "busy"), ("agent_state_changed", "idle"), ("task_completed", None), ("task_failed", None), ("x", None)])
        out.append((i, et, 5 if r.random() < 0.9 else r.randrange(1, 40), ns, i if r.random() < 0.9 else None))
    return out


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_hot_agent_equals_the_batch_fold(spark):
    folder = scratch_path(spark, f"hot-{uuid.uuid4().hex[:8]}")
    log = spark.createDataFrame(hot_log(), SCHEMA)
    log.coalesce(1).sortWithinPartitions("seq").write.parquet(folder)
    agents = Model(spark, SF_SMALL).agents()
    out = run_batches(sq.stream_agent_state(stream(spark, folder), agents, in_order=True), "t2", "update")
    got = latest_per_key(read_batches(spark, out, S.AGENT_OUT), ["agent_id"])
    plain = run_batches(sq.stream_agent_state(stream(spark, folder), agents), "t2", "update")
    assert rows(got, "agent_id", "state", "load_tenths", "last_seq") == rows(
        latest_per_key(read_batches(spark, plain, S.AGENT_OUT), ["agent_id"]), "agent_id", "state", "load_tenths", "last_seq")
    want = ev.agent_state(log, agents).join(ev.agent_load(log, agents), "agent_id").join(got.select("agent_id"), "agent_id", "left_semi")
    assert rows(got, "agent_id", "state", "load_tenths") == rows(want, "agent_id", "state", "load_tenths")
    # the state's task sees runs, not events: one per agent and Arrow batch of 10,000 rows
    runs = spark.read.schema(SCHEMA).parquet(folder).select(F.col("source_agent").alias("agent_id"), "seq", "event_type", "new_state", "task_id") \
                .mapInArrow(S.fold_runs, f"agent_id long, {S.RUNS}")
    assert runs.where("agent_id = 5").count() <= 4 and runs.count() < 200


def test_overlapping_runs_are_refused(spark):
    folder = scratch_path(spark, f"hot-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([(i, "agent_state_changed", 1, "busy", None) for i in (1, 5)], SCHEMA).coalesce(1).write.parquet(f"{folder}/a")
    spark.createDataFrame([(i, "agent_state_changed", 1, "idle", None) for i in (3, 9)], SCHEMA).coalesce(1).write.parquet(f"{folder}/b")
    both = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    with pytest.raises(Exception, match="overlap"):
        run_batches(sq.stream_agent_state(both, Model(spark, SF_SMALL).agents(), in_order=True), "t2", "update")
