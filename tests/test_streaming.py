"""Streaming twins equal their batch operators on the same rows, with the
input split over several files (several micro-batches)."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from fixtures import EVENT_SCHEMA, event
from weft.operators import agents as ag
from weft.operators import events as ev
from weft.operators import resources as rsc
from weft.operators import tasks as tk
from weft.session import scratch_path
from weft.sources.adapters import Model, model_events, model_resource_log
from weft.streaming import queries as sq
from weft.streaming import stateful as S
from weft.streaming.sources import latest_per_key, read_batches, run_batches, with_event_time


def _split_events(spark, n_files=4):
    """Write the sf0.001 raw events as several files in event_id order. The
    file source takes files by modification time, so they are written one
    after another (not by one parallel job) to fix the batch order."""
    import time
    raw = Model(spark, SF_SMALL).raw("events")
    folder = scratch_path(spark, f"split-{uuid.uuid4().hex[:8]}")
    n = raw.count()
    parts = raw.withColumn("f", F.floor(F.col("event_id") * n_files / F.lit(n)))
    for f in range(n_files):
        (parts.where(F.col("f") == f).drop("f").coalesce(1).sortWithinPartitions("event_id")
         .write.parquet(f"{folder}/parts/f{f:03d}"))
        time.sleep(0.05)
    return raw.schema, folder


def _stream(spark, schema, folder):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", "1")
            .option("recursiveFileLookup", "true").parquet(folder + "/parts"))


def test_agent_state_stream_equals_batch(spark):
    schema, folder = _split_events(spark)
    m = Model(spark, SF_SMALL)
    stream = model_events(_stream(spark, schema, folder))
    out = run_batches(sq.stream_agent_state(stream, m.agents()), "t2", "update")
    got = latest_per_key(read_batches(spark, out, S.AGENT_OUT), ["agent_id"])
    assert read_batches(spark, out, S.AGENT_OUT).select("batch_id").distinct().count() > 1
    batch_state = ev.agent_state(m.events(), m.agents())
    batch_load = ev.agent_load(m.events(), m.agents())
    want = batch_state.join(batch_load, "agent_id").join(
        got.select("agent_id"), "agent_id", "left_semi")
    assert rows(got, "agent_id", "state", "load_tenths") == rows(want, "agent_id", "state", "load_tenths")


def test_admission_and_lifecycle_stream_equal_batch(spark):
    schema, folder = _split_events(spark)
    m = Model(spark, SF_SMALL)
    log = model_resource_log(_stream(spark, schema, folder))
    out = run_batches(sq.stream_resource_admission(log, m.resources()), "t4")
    got = read_batches(spark, out, S.ADMISSION_OUT)
    want = rsc.resource_admission(m.resource_log(), m.resources())
    assert rows(got, "seq", "outcome", "holders_after") == rows(want, "seq", "outcome", "holders_after")
    stream = model_events(_stream(spark, schema, folder))
    out = run_batches(sq.stream_task_lifecycle(stream, m.tasks()), "t5")
    got = read_batches(spark, out, sq.LIFECYCLE)
    closed = got.where("status <> 'running' AND started_at IS NULL")  # those that ran from the start
    want = tk.apply_completions(m.tasks(), m.events())
    assert rows(closed, "task_id", "status", "seq") == rows(want, "task_id", "status", "closed_seq")
    begun = m.events().where("event_type = 'task_assigned'").join(m.tasks().where("status = 'pending'"), "task_id", "left_semi")
    assert rows(got.where("status = 'running'"), "task_id") == rows(begun, "task_id")


def test_event_counts_stream(spark):
    schema, folder = _split_events(spark)
    m = Model(spark, SF_SMALL)
    out = run_batches(sq.stream_event_counts(model_events(_stream(spark, schema, folder))), "t1", "update")
    got = latest_per_key(read_batches(spark, out, "event_type string, n long"), ["event_type"])
    want = m.events().groupBy("event_type").count()
    assert rows(got, "event_type", "n") == rows(want, "event_type", "count")


def _heartbeat_stream(spark, batches):
    """Write each list of events as its own file, one after another (the
    file source orders by modification time); stream one file per batch."""
    import time
    folder = scratch_path(spark, f"hb-{uuid.uuid4().hex[:8]}")
    for i, evs in enumerate(batches):
        spark.createDataFrame(evs, EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
        time.sleep(0.05)
    df = (spark.readStream.schema(spark.createDataFrame([], EVENT_SCHEMA).schema)
          .option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder))
    return with_event_time(df)


def test_heartbeat_threshold_and_return_after_alert(spark):
    b1 = [event(1, "x", "a", t=0), event(2, "x", "b", t=0), event(3, "x", "c", t=0),
          event(4, "x", "d", t=0)]
    b2 = [event(5, "x", "a", t=90.0),        # exactly 90 s: no alert
          event(6, "x", "b", t=90.5),        # 90.5 s: alert (gap)
          event(7, "x", "c", t=91.0)]        # 91 s: alert (gap)
    b3 = [event(8, "x", "z", t=400.0)]       # moves the watermark: d's silence is open -> alert
    b4 = [event(9, "x", "d", t=500.0),       # d returns after its alert: no second alert
          event(10, "x", "z", t=1000.0)]
    out = run_batches(sq.stream_heartbeat_alerts(_heartbeat_stream(spark, [b1, b2, b3, b4])), "t3")
    got = read_batches(spark, out, sq.HEARTBEAT_ALERTS.replace("long", "string"))
    alerts = sorted((r["agent_id"], r["kind"]) for r in got.collect())
    # a, b, c return in b2; after b4 the watermark (1000 s) leaves a, b, c and d
    # silent again (open), z is fresh
    assert ("b", "gap") in alerts and ("c", "gap") in alerts
    assert ("a", "gap") not in alerts
    assert alerts.count(("d", "open")) + alerts.count(("d", "gap")) == 2
    assert ("d", "gap") not in alerts


def test_batch_gap_rule_threshold(spark):
    evs = spark.createDataFrame([event(1, "x", "a", t=0), event(2, "x", "a", t=90.0),
                                 event(3, "x", "b", t=0), event(4, "x", "b", t=90.5),
                                 event(5, "x", "c", t=0), event(6, "x", "c", t=91)], EVENT_SCHEMA)
    got = rows(ag.silence_gaps(evs), "agent_id", "silence_seconds")
    assert got == [("b", 90.5), ("c", 91.0)]
    # last events: a at 90 s, b at 90.5 s, c at 91 s; as_of 180.5 s
    as_of = F.lit("2024-01-01 00:03:00.5").cast("timestamp")
    silent = rows(ag.heartbeat_timeouts(evs, as_of), "agent_id", "silence_seconds")
    assert silent == [("a", 90.5)]      # b: exactly 90 s, no alert
    states = spark.createDataFrame([("a", "error"), ("b", "idle")], "agent_id string, state string")
    assert ag.heartbeat_timeouts(evs, as_of, states=states).count() == 0   # a already in error


def test_fan_out_isolates_failing_observer(spark):
    seen, errors = [], {}

    def good(batch, bid):
        seen.append(batch.count())

    def bad(batch, bid):
        raise RuntimeError("observer failure")

    handler = sq.fan_out({"good": good, "bad": bad}, errors)
    df = spark.createDataFrame([event(1, "task_completed", "a", task_id="t")], EVENT_SCHEMA)
    handler(df, 0)
    handler(df, 1)
    assert seen == [1, 1] and errors == {"bad": 2}
    routed = []
    route = sq.by_event_type({"task_failed": bad, "task_completed": lambda b, i: routed.append(b.count())})
    route(df, 0)
    assert routed == [1] and route.errors == {"task_failed": 1}
    alone = sq.fan_out({"bad": bad})
    alone(df, 0)
    assert alone.errors == {"bad": 1}


def test_tables_in_part_files_stream_like_single_files(spark, tmp_path):
    from weft.plans.catalog import all_queries
    folder = str(tmp_path)
    for name in ("events", "supplier", "nation", "orders"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for name in ("stream_event_counts", "stream_agent_state", "stream_heartbeat_alerts", "stream_resource_admission",
                 "stream_task_lifecycle", "tumbling_event_counts", "window_alerts", "stream_event_log"):
        one = sorted(map(tuple, all_queries()[name](spark, SF_SMALL).collect()), key=str)
        many = sorted(map(tuple, all_queries()[name](spark, folder).collect()), key=str)
        assert one == many and (one or name == "stream_task_lifecycle"), name


def test_a_stream_that_is_not_done_in_time_raises(spark):
    import pytest
    slow = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    with pytest.raises(TimeoutError):
        run_batches(slow.selectExpr("value"), "late", available_now=False, timeout_s=2)


def test_an_empty_stream_reads_back_as_no_rows(spark, tmp_path):
    spark.createDataFrame([], "a long").write.parquet(str(tmp_path / "none"))
    out = run_batches(spark.readStream.schema("a long").parquet(str(tmp_path / "none")), "none")
    assert read_batches(spark, out, "a long").collect() == []


def test_tumbling_counts_closed_windows(spark):
    evs = [event(i, "task_failed" if i % 5 == 0 else "x", "a", t=i * 7, execution_time=None)
           for i in range(1, 40)]
    stream = _heartbeat_stream(spark, [evs[:20], evs[20:]])
    out = run_batches(sq.tumbling_event_counts(stream), "t6")
    got = read_batches(spark, out, "window_start timestamp, event_type string, n long")
    total = sum(r["n"] for r in got.collect())
    # windows closed by the final watermark (last event at 273 s -> windows ending <= 273 s)
    assert total == sum(1 for e in evs if e[0] * 7 < 270)


def test_restart_from_checkpoint_continues(spark):
    """Stop after half the files, add the rest, restart on the same
    checkpoint: the union of both runs equals the batch result."""
    m = Model(spark, SF_SMALL)
    raw = m.raw("events")
    n = raw.count()
    base = scratch_path(spark, f"restart-{uuid.uuid4().hex[:8]}")
    src = base + "/src"
    parts = raw.withColumn("f", F.floor(F.col("event_id") * 4 / F.lit(n)))

    def add(fs):
        for f in fs:
            parts.where(F.col("f") == f).drop("f").coalesce(1).write.parquet(f"{src}/f{f}")

    def run():
        stream = (spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", "1")
                  .option("recursiveFileLookup", "true").parquet(src))
        q = sq.stream_resource_admission(model_resource_log(stream), m.resources())
        return run_batches(q, "restart", base=base + "/run")

    add([0, 1])
    run()
    first = read_batches(spark, base + "/run/out", S.ADMISSION_OUT).count()
    add([2, 3])
    out = run()
    got = read_batches(spark, out, S.ADMISSION_OUT)
    assert 0 < first < got.count()
    want = rsc.resource_admission(m.resource_log(), m.resources())
    assert rows(got, "seq", "outcome", "holders_after") == rows(want, "seq", "outcome", "holders_after")


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
import numpy as np  # noqa: E402


def _loop(ts, last, alerted, timeout):
    out = []
    for t in ts:
        if last is not None and t - last > timeout and not alerted:
            out.append(last)
        if last is None or t >= last:
            last, alerted = t, False
    return out, last, alerted


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=30),
       st.one_of(st.none(), st.integers(0, 400)), st.booleans())
def test_gap_alerts_equals_loop(ts, stored, alerted):
    """The vectorised gap rule equals the event-by-event rule."""
    alerted = alerted and stored is not None
    got = S.gap_alerts(np.array(ts, dtype=np.int64), stored, alerted, 90)
    assert got == _loop(ts, stored, alerted, 90)


def test_heartbeat_multi_batch_equals_batch(spark):
    """T3 over four micro-batches: the reported silences (agent, last
    heartbeat) equal the batch gap rule plus the silences still open at the
    final watermark, whatever batch a timer fired in."""
    schema, folder = _split_events(spark)
    m = Model(spark, SF_SMALL)
    stream = with_event_time(model_events(_stream(spark, schema, folder)))
    out = run_batches(sq.stream_heartbeat_alerts(stream), "t3multi")
    got = read_batches(spark, out, sq.HEARTBEAT_ALERTS)
    got = {(r["agent_id"], r["last_seen"].replace(tzinfo=None)) for r in got.collect()}
    ev = m.events()
    wm = ev.select(F.max("ts")).collect()[0][0]
    wm = wm.replace(microsecond=wm.microsecond // 1000 * 1000)      # watermark is in ms
    gaps = {(r["agent_id"], r["last_seen"]) for r in ag.silence_gaps(ev).collect()}
    opened = {(r["agent_id"], r["last_seen"]) for r in ag.heartbeat_timeouts(
        ev, F.lit(wm).cast("timestamp_ntz")).collect()}
    assert got == gaps | opened


def test_window_alerts_stream(spark):
    """A window alerts on error share above 5 % or an execution over 5 s."""
    evs = [event(1, "x", "a", t=1), event(2, "task_failed", "a", t=2),            # window 0: 50 % errors
           event(3, "task_completed", "a", task_id="t", t=31, execution_time=6.0),  # window 1: 6 s
           event(4, "x", "a", t=62), event(5, "task_completed", "a", task_id="u", t=63,
                                              execution_time=1.0),                  # window 2: quiet
           event(6, "x", "a", t=200)]                                               # closes 0-2
    out = run_batches(sq.window_alerts(_heartbeat_stream(spark, [evs])), "t7")
    got = read_batches(spark, out, "window_start timestamp, events long, errors long, "
                       "error_alert boolean, latency_alert boolean")
    res = sorted((r["events"], r["errors"], r["error_alert"], r["latency_alert"]) for r in got.collect())
    assert res == [(1, 0, False, True), (2, 1, True, False)]


def test_tumbling_counts_drop_late_events(spark):
    """T6 late-data rule (Spark's): a row older than the watermark that
    closed earlier batches is dropped, so an emitted window is never
    re-opened or emitted twice. A row that arrives while its window is still
    held in state is counted."""
    b1 = [event(i, "x", "a", t=i * 10) for i in range(1, 11)]           # up to 100 s
    b2 = [event(21, "x", "a", t=200)]                                    # closes windows < 200 s
    b3 = [event(22, "x", "a", t=5), event(23, "x", "a", t=400)]          # 5 s is late
    out = run_batches(sq.tumbling_event_counts(_heartbeat_stream(spark, [b1, b2, b3])), "late")
    got = read_batches(spark, out, "window_start timestamp, event_type string, n long")
    first = [r["n"] for r in got.collect() if r["window_start"].second == 0 and r["window_start"].minute == 0]
    assert first == [2]          # events at 10 s and 20 s, emitted once; the late 5 s row dropped


def test_task_lifecycle_folds_a_bucket_at_once(spark):
    """Two buckets hold all tasks: a few calls a batch, not one for each task, and
    tasks that begin in one batch end in a later one."""
    n = 400
    status = {i: ("pending", "running", "completed")[i % 3] for i in range(n)}
    tasks = spark.createDataFrame([*status.items(), (None, "pending")], "task_id long, status string")
    kinds = {0: ["task_completed", "task_assigned", "task_assigned"], 1: ["task_assigned", "task_failed"], 2: ["task_completed"]}
    later = {0: ["task_failed", "task_completed"], 1: ["task_completed"], 2: ["task_assigned"]}
    batches, seq, want = [], 0, []
    for given in (kinds, later):
        evs = []
        for i in [*range(0, n), n + 5]:
            for k in given[i % 3]:
                seq += 1
                evs.append(event(seq, k, "a", t=seq, task_id=str(i)))
                if i < n and k == "task_assigned" and status[i] == "pending":
                    status[i] = "running"
                    want.append((i, "running", seq, True))
                elif i < n and status[i] == "running" and k != "task_assigned":
                    status[i] = k.split("_")[1]
                    want.append((i, status[i], seq, i % 3 == 0))
        batches.append(evs)
    stream = _heartbeat_stream(spark, batches).withColumn("task_id", F.col("task_id").cast("long"))
    out = run_batches(sq.stream_task_lifecycle(stream, tasks, buckets=2), "t5-buckets")
    got = read_batches(spark, out, sq.LIFECYCLE).selectExpr("task_id", "status", "seq", "started_at IS NOT NULL AS began")
    assert rows(got, "task_id", "status", "seq", "began") == sorted(want)
