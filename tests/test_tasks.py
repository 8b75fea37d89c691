from conftest import rows
from fixtures import EVENT_SCHEMA, TASK_SCHEMA, event, task
from weft.operators import tasks as tk


def _tasks(spark):
    return spark.createDataFrame([
        task(1, "done", "x", 2, [], "completed"),
        task(2, "bad", "x", 2, [], "failed"),
        task(3, "run", "x", 2, [], "running"),
        task(4, "q0", "x", 3, [], "pending"),                  # no dependencies
        task(5, "q1", "x", 3, ["done"], "pending"),            # satisfied
        task(6, "q2", "x", 4, ["run"], "pending"),             # running dep
        task(7, "q3", "x", 2, ["bad"], "pending"),             # failed dep
        task(8, "q4", "x", 2, ["nope"], "pending"),            # unknown dep
        task(9, "q5", "x", 2, ["q0"], "pending"),              # queued dep
        task(10, "q6", "x", 3, [], "pending"),                 # equal priority, later
        task(11, "run2", "y", 1, [], "running"),
    ], TASK_SCHEMA)


def test_ready_and_blocked(spark):
    t = _tasks(spark)
    assert [r[0] for r in rows(tk.ready_tasks(t), "task_id")] == ["q0", "q1", "q6"]
    got = rows(tk.blocked_tasks(t), "task_id", "dependency", "reason")
    assert got == [("q2", "run", "running"), ("q3", "bad", "failed"),
                   ("q4", "nope", "not_completed"), ("q5", "q0", "not_completed")]


def test_dispatch_queue_fifo_within_priority(spark):
    got = rows(tk.dispatch_queue(_tasks(spark)), "queue_pos", "task_id")
    assert got == [(1, "q0"), (2, "q1"), (3, "q6")]


def test_stats_and_totals(spark):
    s = tk.task_stats(_tasks(spark)).collect()[0].asDict()
    assert s == {"queued_tasks": 7, "active_tasks": 2, "completed_tasks": 2, "failed_tasks": 1}
    t = tk.task_totals(_tasks(spark)).collect()[0].asDict()
    assert t == {"total_tasks": 11, "completed": 1, "failed": 1, "pending": 7, "running": 2}


def test_queue_sizes_zero_rows_kept(spark):
    q = tk.queue_sizes(_tasks(spark)).collect()[0].asDict()
    assert q == {"queue_low": 0, "queue_medium": 3, "queue_high": 3, "queue_critical": 1}
    empty = tk.queue_sizes(spark.createDataFrame([], TASK_SCHEMA)).collect()
    assert [r.asDict() for r in empty] == [{"queue_low": 0, "queue_medium": 0, "queue_high": 0,
                                             "queue_critical": 0}]


def test_apply_completions_first_terminal_only(spark):
    e = spark.createDataFrame([
        event(20, "task_completed", "a", task_id="run"),
        event(21, "task_failed", "a", task_id="run"),      # later duplicate: ignored
        event(22, "task_failed", "b", task_id="run2"),
        event(23, "task_completed", "b", task_id="q0"),    # not running: ignored
    ], EVENT_SCHEMA)
    got = rows(tk.apply_completions(_tasks(spark), e), "task_id", "status", "closed_seq", "error")
    assert got == [("run", "completed", 20, None), ("run2", "failed", 22, "Unknown error")]
