"""Structured Streaming twins of the batch operators.

Every function takes a *streaming* DataFrame of model rows and returns a
streaming DataFrame; :func:`weft.streaming.sources.run_batches` runs it.
"""

from __future__ import annotations

import logging
from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.streaming import stateful as S

log = logging.getLogger(__name__)

WINDOW = "30 seconds"          # collection interval (declared)
HEARTBEAT_ALERTS = "agent_id long, last_seen timestamp, kind string"   # output of T3
ERROR_SHARE_ALERT = 0.05       # alert thresholds (declared)
RESPONSE_MS_ALERT = 5000.0


def stream_event_counts(events: DataFrame) -> DataFrame:
    """Running count per event type (update mode)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_agent_state(events: DataFrame, agents: DataFrame, in_order: bool = False) -> DataFrame:
    """Keyed by agent; the registry is the initial state. ``in_order``: the
    events lie in their files by ``seq``, as an arrival log does; then each
    Arrow batch is folded before the shuffle, and a hot agent's micro-batch
    reaches its task as a few rows (:func:`weft.streaming.stateful.fold_runs`)."""
    init = agents.select("agent_id", "state", "load_factor").groupBy("agent_id")
    rows = events.select(F.col("source_agent").alias("agent_id"), "seq", "event_type", "new_state", "task_id")
    processor = S.AgentStateProcessor()
    if in_order:
        key_type = events.schema["source_agent"].dataType.simpleString()
        rows, processor = rows.mapInArrow(S.fold_runs, f"agent_id {key_type}, {S.RUNS}"), S.AgentRunsProcessor()
    return (rows.groupBy("agent_id")
            .transformWithStateInPandas(processor, S.AGENT_OUT, "Update", "None", initialState=init))


def stream_heartbeat_alerts(events: DataFrame, timeout_s: float = 90.0,
                            agents: DataFrame | None = None) -> DataFrame:
    """Silence alerts with event-time timers (needs a watermark on ts).
    With ``agents`` (agent_id, state), only registered agents that are not in
    the error state are reported, as the monitor does.
    Times cross into Python as epoch microseconds, so the session time zone
    never shifts them; ``last_seen`` comes back as a timestamp."""
    key_type = events.schema["source_agent"].dataType.simpleString()
    out = S.HEARTBEAT_OUT.replace("agent_id long", f"agent_id {key_type}")
    beats = events.select(F.col("source_agent").alias("agent_id"), "seq", "ts",
                          F.unix_micros("ts").alias("ts_us"), "event_type", "new_state", "task_id")
    processor = S.HeartbeatProcessor(timeout_s)
    if agents is None:
        beats = beats.drop("event_type", "new_state", "task_id")
    else:  # a stream-static join: the registry is read with each batch
        beats = beats.join(agents.select("agent_id", F.col("state").alias("reg_state")), "agent_id")
        processor = S.RegisteredHeartbeatProcessor(timeout_s)
    return (beats.groupBy("agent_id").transformWithStateInPandas(processor, out, "Append", "EventTime")
            .select("agent_id", F.timestamp_micros("last_seen_us").alias("last_seen"), "kind"))


COORDINATION = "agent_id long, kind string, state string, load_tenths long, last_seq long, last_seen timestamp"


def stream_coordination(events: DataFrame, timeout_s: float = 90.0) -> DataFrame:
    """S11 + T2 + T3 over one event log (needs a watermark on ts): agents register
    while the stream runs and count from then on, and one that stays silent from
    its registration is reported. See :class:`CoordinationProcessor`."""
    rows = events.select(F.col("source_agent").alias("agent_id"), "seq", "ts", F.unix_micros("ts").alias("ts_us"),
                         "event_type", "new_state", "task_id")
    out = S.COORDINATION_OUT.replace("agent_id long", f"agent_id {events.schema['source_agent'].dataType.simpleString()}")
    return (rows.groupBy("agent_id").transformWithStateInPandas(S.CoordinationProcessor(timeout_s), out, "Update", "EventTime")
            .select("agent_id", "kind", "state", "load_tenths", "last_seq", F.timestamp_micros("last_seen_us").alias("last_seen")))


def latest_agent_states(out: DataFrame) -> DataFrame:
    """The last state row per agent of :func:`stream_coordination`'s output (with
    ``batch_id``). In one batch a timer's row, which tells of an error, comes last."""
    last = F.struct("batch_id", (F.col("state") == "error").cast("int"))
    return (out.where("kind = 'state'").groupBy("agent_id")
            .agg(F.max_by(F.struct("state", "load_tenths", "last_seq", "last_seen"), last).alias("v")).select("agent_id", "v.*"))


def stream_resource_admission(log: DataFrame, resources: DataFrame) -> DataFrame:
    """T4: keyed by resource; the registry is the initial state."""
    init = resources.select("resource_id", "max_concurrent").groupBy("resource_id")
    return (log.select("resource_id", "seq", "agent_id", "action").groupBy("resource_id")
            .transformWithStateInPandas(S.ResourceAdmissionProcessor(), S.ADMISSION_OUT,
                                        "Append", "None", initialState=init))


TASK_BUCKETS = 1024            # keys of the task state; a checkpoint holds for one number


def stream_task_lifecycle(events: DataFrame, tasks: DataFrame, buckets: int = TASK_BUCKETS) -> DataFrame:
    """T5: keyed by a hash of the task id; pending and running tasks are the initial
    state, and only assignments and terminal events are read. One row per change of a
    task's status, with the time it was started (null if that was not seen)."""
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).alias("bucket")
    init = (tasks.where(F.col("task_id").isNotNull() & F.col("status").isin("pending", "running"))
            .select(bucket, "task_id", "status").groupBy("bucket"))
    ev = (events.where(F.col("task_id").isNotNull()
                       & F.col("event_type").isin("task_assigned", "task_completed", "task_failed"))
          .select(bucket, "task_id", "seq", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")))
    return (ev.groupBy("bucket")
            .transformWithStateInPandas(S.TaskLifecycleProcessor(), S.LIFECYCLE_OUT, "Append",
                                        "None", initialState=init)
            .select("task_id", "status", "seq", F.timestamp_micros("started_us").alias("started_at")))


LIFECYCLE = "task_id long, status string, seq long, started_at timestamp"


def tumbling_event_counts(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Events per tumbling window and type; append mode emits a window
    once the watermark passes its end, and its state is dropped. Late data
    (our rule, Spark's): a row older than the watermark that closed earlier
    batches is dropped, so an emitted window is never emitted again; a row
    whose window is still held in state is counted."""
    return (events.groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))


def window_alerts(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Windows whose error share exceeds 5 % or whose slowest reported
    execution exceeds 5000 ms."""
    agg = (events.groupBy(F.window("ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("events"),
                F.count_if(F.col("event_type") == "task_failed").alias("errors"),
                F.max("execution_time").alias("max_exec")))
    share = F.col("errors").cast("double") / F.col("events").cast("double")
    ms = F.col("max_exec") * 1000.0
    return (agg.where((share > ERROR_SHARE_ALERT) | (ms > RESPONSE_MS_ALERT))
            .select(F.col("w.start").alias("window_start"), "events", "errors",
                    (share > ERROR_SHARE_ALERT).alias("error_alert"),
                    F.coalesce(ms > RESPONSE_MS_ALERT, F.lit(False)).alias("latency_alert")))


Observer = Callable[[DataFrame, int], None]


def _isolated(name: str, fn: Observer, batch: DataFrame, batch_id: int, errs: dict) -> None:
    """Call one observer; a failure is logged and counted, not raised."""
    try:
        fn(batch, batch_id)
    except Exception:  # noqa: BLE001 - observers are isolated
        errs[name] = errs.get(name, 0) + 1
        log.exception("observer %s failed on batch %s", name, batch_id)


def fan_out(observers: Mapping[str, Observer], errors: dict | None = None
            ) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each micro-batch
    to every observer. The batch is persisted once for all of them; an
    observer that raises is logged and counted, and the others still run.
    The counts are in ``errors`` and, always, in the function's own
    ``errors`` attribute."""
    errs = errors if errors is not None else {}

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, fn in observers.items():
                _isolated(name, fn, batch, batch_id, errs)
        finally:
            batch.unpersist()
    run.errors = errs
    return run


def by_event_type(handlers: Mapping[str, Observer], errors: dict | None = None) -> Observer:
    """Route each batch's events to the handler of their type; one that
    fails is logged and counted (``errors``), the later ones still run."""
    errs = errors if errors is not None else {}

    def run(batch: DataFrame, batch_id: int) -> None:
        for et, fn in handlers.items():
            _isolated(et, fn, batch.where(F.col("event_type") == et), batch_id, errs)
    run.errors = errs
    return run
