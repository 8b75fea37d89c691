"""Catalog entries: task-table operators."""

from pyspark.sql import functions as F

from weft.operators import tasks as tk
from weft.operators.events import TASK_COMPLETED, TASK_FAILED
from weft.plans.catalog import query, with_ctes

BLOCKED_SQL = """blocked AS (
  SELECT e.task_id, e.dependency,
         CASE WHEN s.status = 'running' THEN 'running' WHEN s.status = 'failed' THEN 'failed'
              ELSE 'not_completed' END AS reason
  FROM (SELECT task_id, unnest(dependencies) AS dependency FROM tk WHERE status = 'pending') e
  LEFT JOIN tk s ON s.task_id = e.dependency
  WHERE s.status IS NULL OR s.status <> 'completed')"""
READY_SQL = """ready AS (
  SELECT task_id, seq, task_type, priority FROM tk
  WHERE status = 'pending' AND task_id NOT IN (SELECT task_id FROM blocked))"""
FIRST_TERMINAL_SQL = """ft AS (
  SELECT * FROM (
    SELECT task_id, seq, event_type, ts, source_agent, execution_time, error,
           row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rn
    FROM ev WHERE event_type IN ('task_completed', 'task_failed') AND task_id IS NOT NULL)
  WHERE rn = 1)"""
CLOSED_SQL = """closed AS (
  SELECT t.task_id, CASE WHEN f.event_type = 'task_failed' THEN 'failed' ELSE 'completed' END AS status,
         f.seq AS closed_seq, f.ts AS completed_at, f.source_agent AS agent_id,
         CASE WHEN f.event_type = 'task_failed' THEN coalesce(f.error, 'Unknown error') END AS error,
         t.created_at, f.execution_time
  FROM tk t JOIN ft f ON t.task_id = f.task_id WHERE t.status = 'running')"""


@query("blocked_tasks", with_ctes(["tk"], "SELECT * FROM blocked", [BLOCKED_SQL]))
def q_blocked(m):
    return tk.blocked_tasks(m.tasks())


@query("ready_tasks", with_ctes(["tk"], "SELECT * FROM ready", [BLOCKED_SQL, READY_SQL]))
def q_ready(m):
    return tk.ready_tasks(m.tasks())


@query("dispatch_queue", with_ctes(["tk"], """
SELECT task_id, seq, task_type, priority,
       row_number() OVER (PARTITION BY task_type ORDER BY priority DESC, seq) AS queue_pos
FROM ready""", [BLOCKED_SQL, READY_SQL]))
def q_dispatch(m):
    return tk.dispatch_queue(m.tasks())


@query("priority_order", with_ctes(["tk"], """
SELECT task_id, seq, priority, row_number() OVER (ORDER BY priority DESC, seq) AS position
FROM tk WHERE status = 'pending'"""))
def q_priority_order(m):
    return tk.priority_order(m.tasks())


@query("task_stats", with_ctes(["tk"], """
SELECT count(*) FILTER (WHERE status = 'pending') AS queued_tasks,
       count(*) FILTER (WHERE status = 'running') AS active_tasks,
       count(*) FILTER (WHERE status IN ('completed', 'failed')) AS completed_tasks,
       count(*) FILTER (WHERE status = 'failed') AS failed_tasks FROM tk"""))
def q_task_stats(m):
    return tk.task_stats(m.tasks())


@query("queue_sizes", with_ctes(["tk"], """
SELECT count(*) FILTER (WHERE status = 'pending' AND priority = 1) AS queue_low,
       count(*) FILTER (WHERE status = 'pending' AND priority = 2) AS queue_medium,
       count(*) FILTER (WHERE status = 'pending' AND priority = 3) AS queue_high,
       count(*) FILTER (WHERE status = 'pending' AND priority = 4) AS queue_critical FROM tk"""))
def q_queue_sizes(m):
    return tk.queue_sizes(m.tasks())


@query("task_totals", with_ctes(["tk"], """
SELECT count(*) AS total_tasks, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'running') AS running FROM tk"""))
def q_task_totals(m):
    return tk.task_totals(m.tasks())


@query("apply_completions", with_ctes(["ev", "tk"], "SELECT * FROM closed",
                                      [FIRST_TERMINAL_SQL, CLOSED_SQL]))
def q_apply_completions(m):
    return tk.apply_completions(m.tasks(), m.events())


@query("task_latency", with_ctes(["ev", "tk"], """
SELECT task_id, status,
       CAST(epoch_us(completed_at) - epoch_us(created_at) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS total_seconds,
       CAST(coalesce(epoch_us(completed_at) - epoch_us(b.assigned_at), CAST(round(execution_time * 1000000) AS BIGINT)) AS DOUBLE)
         / CAST(1000000 AS DOUBLE) AS run_seconds,
       CAST(epoch_us(completed_at) - epoch_us(created_at)
            - coalesce(epoch_us(completed_at) - epoch_us(b.assigned_at), CAST(round(execution_time * 1000000) AS BIGINT)) AS DOUBLE)
         / CAST(1000000 AS DOUBLE) AS queue_seconds,
       execution_time
FROM closed LEFT JOIN (SELECT task_id, min(ts) AS assigned_at FROM ev WHERE event_type = 'task_assigned' GROUP BY task_id) b
  USING (task_id)""", [FIRST_TERMINAL_SQL, CLOSED_SQL]))
def q_task_latency(m):
    return tk.task_latency(m.tasks(), m.events())


@query("result_by_task", with_ctes(["ev", "tk"], """
SELECT tk.task_id, status, CASE WHEN status = 'completed' THEN e.execution_time END AS result,
       CASE WHEN status = 'failed' THEN 'Task failed: ' || coalesce(e.error, 'Unknown error') END AS error
FROM tk JOIN (SELECT task_id, arg_min(execution_time, seq) AS execution_time, max(error) AS error
              FROM ev WHERE event_type IN ('task_completed', 'task_failed') GROUP BY task_id) e ON tk.task_id = e.task_id
WHERE status IN ('completed', 'failed')"""))
def q_result_by_task(m):
    wanted = m.events().where(F.col("event_type").isin(TASK_COMPLETED, TASK_FAILED)).select("task_id")
    return tk.result_by_task(m.tasks(), wanted, m.events())


@query("priority_labels", with_ctes(["tk"], """
SELECT task_id, priority, CASE priority WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH'
       WHEN 4 THEN 'CRITICAL' END AS priority_name FROM tk"""))
def q_priority_labels(m):
    return tk.priority_labels(m.tasks())
