"""Task-table operators: readiness, blocking, queues, completion, latency.

Input is the model ``tasks`` table: ``task_id, seq, task_type, priority,
dependencies ARRAY, status`` with status in pending / running / completed /
failed. ``pending`` is the queue; ``running`` is the active set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.scalar import seconds_between
from weft.operators.events import DEFAULT_ERROR, TASK_ASSIGNED, TASK_COMPLETED, TASK_FAILED
from weft.plans.ordered import rank_within

# Priority ordinals and labels.
PRIORITY_LABELS = {1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"


def dependency_edges(tasks: DataFrame) -> DataFrame:
    """Queued tasks exploded to one row per dependency, with the status of
    the dependency (null when the id is unknown). The join is an equi-join on
    the dependency id; both sides shuffle on it (or the status side is
    broadcast when AQE measures it small)."""
    edges = (tasks.where(F.col("status") == PENDING)
             .select("task_id", F.explode("dependencies").alias("dependency")))
    status = tasks.select(F.col("task_id").alias("dependency"), F.col("status").alias("dep_status"))
    return edges.join(status, "dependency", "left")


def blocked_tasks(tasks: DataFrame) -> DataFrame:
    """Queued task, blocking dependency and reason. A dependency blocks
    unless it is completed: running -> ``running``, failed -> ``failed``,
    queued or unknown -> ``not_completed`` (no cascade, no timeout)."""
    e = dependency_edges(tasks)
    reason = (F.when(F.col("dep_status") == RUNNING, "running")
              .when(F.col("dep_status") == FAILED, "failed")
              .otherwise("not_completed"))
    return (e.where(F.col("dep_status").isNull() | (F.col("dep_status") != COMPLETED))
            .select("task_id", "dependency", reason.alias("reason")))


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Queued tasks whose dependencies are all completed (none failed,
    running or unknown): queued anti-joined with the blocked ids."""
    blocked = blocked_tasks(tasks).select("task_id")
    return (tasks.where(F.col("status") == PENDING)
            .join(blocked, "task_id", "left_anti")
            .select("task_id", "seq", "task_type", "priority"))


def dispatch_queue(tasks: DataFrame) -> DataFrame:
    """Ready tasks ranked per task type by priority (high first), then
    arrival. The rank is computed by :func:`rank_within`, so one hot task
    type is still ranked by many tasks."""
    return rank_within(ready_tasks(tasks), ["task_type"], "seq",
                       order=[("priority", False)], name="queue_pos", materialize=True)


def priority_order(tasks: DataFrame) -> DataFrame:
    """K3: queued tasks in global dispatch order (priority desc, arrival)."""
    q = tasks.where(F.col("status") == PENDING).select("task_id", "seq", "priority")
    return rank_within(q, [], "seq", order=[("priority", False)], name="position")


def task_stats(tasks: DataFrame) -> DataFrame:
    """A2: queued, active, completed (failed included, as the reference
    counts) and failed, in one pass."""
    s = F.col("status")
    return tasks.agg(
        F.count_if(s == PENDING).alias("queued_tasks"),
        F.count_if(s == RUNNING).alias("active_tasks"),
        F.count_if(s.isin(COMPLETED, FAILED)).alias("completed_tasks"),
        F.count_if(s == FAILED).alias("failed_tasks"))


def queue_sizes(tasks: DataFrame) -> DataFrame:
    """A3: queued tasks per priority; a priority with no task reports 0 and
    an empty table still yields one row."""
    pend = F.col("status") == PENDING
    return tasks.agg(*[F.count_if(pend & (F.col("priority") == k)).alias(f"queue_{v.lower()}")
                       for k, v in PRIORITY_LABELS.items()])


def task_totals(tasks: DataFrame) -> DataFrame:
    """A4 (simple coordinator): completed excludes failed; ``running`` is
    added because the reference's buckets leave running tasks out."""
    s = F.col("status")
    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(s == COMPLETED).alias("completed"),
        F.count_if(s == FAILED).alias("failed"),
        F.count_if(s == PENDING).alias("pending"),
        F.count_if(s == RUNNING).alias("running"))


def terminal_events(events: DataFrame) -> DataFrame:
    """First terminal (completed/failed) event per task id, by ``seq``.
    ``min_by`` aggregates partially before the shuffle, so a task id that
    appears in a huge number of events costs one row per map task."""
    t = events.where(F.col("event_type").isin(TASK_COMPLETED, TASK_FAILED)
                     & F.col("task_id").isNotNull())
    first = F.min_by(F.struct("seq", "event_type", "ts", "source_agent", "execution_time",
                              "error"), "seq")
    return t.groupBy("task_id").agg(first.alias("e")).select("task_id", "e.*")


def apply_completions(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Running tasks closed by their first terminal event. Later or
    duplicate terminal events and events for tasks that are not running do
    not change a task."""
    first = terminal_events(events)
    active = tasks.where(F.col("status") == RUNNING).select("task_id", "created_at")
    failed = F.col("event_type") == TASK_FAILED
    return active.join(first, "task_id", "inner").select(
        "task_id",
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(COMPLETED)).alias("status"),
        F.col("seq").alias("closed_seq"),
        F.col("ts").alias("completed_at"),
        F.col("source_agent").alias("agent_id"),
        F.when(failed, F.coalesce("error", F.lit(DEFAULT_ERROR))).alias("error"),
        "created_at", "execution_time")


def task_latency(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """For each closed task, seconds from creation to completion (difference
    in microseconds / 1e6), split into the wait in the queue and the run. A run
    starts with the task's first assignment; where none was seen, the reported
    execution time before the completion."""
    c = apply_completions(tasks, events)
    begun = events.where((F.col("event_type") == TASK_ASSIGNED) & F.col("task_id").isNotNull()) \
                  .groupBy("task_id").agg(F.min("ts").alias("assigned_at"))
    c = c.join(begun, "task_id", "left")
    done, made = F.col("completed_at"), F.col("created_at")
    us = F.round(F.col("execution_time") * 1_000_000).cast("bigint")
    run_us = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("assigned_at"), done), us)
    total_us = F.timestamp_diff("MICROSECOND", made.cast(c.schema["completed_at"].dataType), done)
    return c.select("task_id", "status", seconds_between(made, done).alias("total_seconds"),
                    (run_us.cast("double") / 1_000_000).alias("run_seconds"),
                    ((total_us - run_us).cast("double") / 1_000_000).alias("queue_seconds"), "execution_time")


def result_by_task(tasks: DataFrame, wanted: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """P10: results of finished tasks among the ``wanted`` ids (semi join).
    With ``events``, the result is the execution time and the error the text
    the task's terminal event reports. A failed task reports ``Task failed:
    <error>`` instead of raising; the error is unknown if none was given."""
    fin = tasks.where(F.col("status").isin(COMPLETED, FAILED)) \
               .join(wanted.select("task_id").distinct(), "task_id", "left_semi")
    if events is None:
        fin = fin.withColumns({"execution_time": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    else:
        fin = fin.join(terminal_events(events).select("task_id", "execution_time", "error"), "task_id", "left")
    failed = F.col("status") == FAILED
    return fin.select("task_id", "status", F.when(~failed, F.col("execution_time")).alias("result"),
                      F.when(failed, F.concat(F.lit("Task failed: "), F.coalesce("error", F.lit(DEFAULT_ERROR)))).alias("error"))


def priority_labels(tasks: DataFrame) -> DataFrame:
    """Ordinal to label (and back) for every task."""
    m = F.create_map(*[x for k, v in PRIORITY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return tasks.select("task_id", "priority", m[F.col("priority")].alias("priority_name"))
