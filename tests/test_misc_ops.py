from decimal import Decimal
"""Fixture checks for operators otherwise covered only by the SQL oracle."""

from pyspark.sql import functions as F

from conftest import rows
from fixtures import AGENT_SCHEMA, EVENT_SCHEMA, TASK_SCHEMA, event, task
from weft.operators import agents as ag
from weft.operators import corpus as cp
from weft.operators import events as ev
from weft.operators import metrics as mt
from weft.operators import reports as rp
from weft.operators import resources as rsc
from weft.operators import tasks as tk


def _tasks(spark):
    return spark.createDataFrame([
        task(1, "a", "x", 2, [], "pending"), task(2, "b", "x", 4, [], "pending"),
        task(3, "c", "x", 4, [], "pending"), task(4, "d", "x", 2, [], "completed"),
        task(5, "e", "x", 2, [], "failed"), task(6, "f", "x", 1, [], "running"),
    ], TASK_SCHEMA)


def _events(spark):
    return spark.createDataFrame([
        event(10, "task_completed", "w", task_id="f", t=100, execution_time=2.5),
        event(11, "task_completed", "w", task_id="d", t=101),
        event(12, "task_failed", "w", task_id="x", t=130),
    ], EVENT_SCHEMA)


def test_priority_order_and_labels(spark):
    got = rows(tk.priority_order(_tasks(spark)), "position", "task_id")
    assert got == [(1, "b"), (2, "c"), (3, "a")]
    labels = dict(rows(tk.priority_labels(_tasks(spark)), "task_id", "priority_name"))
    assert labels["b"] == "CRITICAL" and labels["f"] == "LOW"


def test_result_by_task_and_latency(spark):
    wanted = spark.createDataFrame([("d",), ("e",), ("a",), ("d",)], "task_id string")
    got = rows(tk.result_by_task(_tasks(spark), wanted), "task_id", "status", "error")
    assert got == [("d", "completed", None), ("e", "failed", "Task failed: Unknown error")]
    told = spark.createDataFrame([(1, "task_failed", "e", "disk full", None), (2, "task_completed", "d", None, 2.0)],
                                 "seq long, event_type string, task_id string, error string, execution_time double")
    told = told.selectExpr("*", "timestamp'2024-01-01' AS ts", "'w' AS source_agent")
    got = rows(tk.result_by_task(_tasks(spark), wanted, told), "task_id", "result", "error")
    assert got == [("d", 2.0, None), ("e", None, "Task failed: disk full")]
    lat = rows(tk.task_latency(_tasks(spark), _events(spark)), "task_id", "total_seconds", "execution_time")
    assert lat == [("f", 94.0, 2.5)]       # created at 6 s, closed at 100 s
    assert rows(tk.task_latency(_tasks(spark), _events(spark)), "queue_seconds", "run_seconds") == [(91.5, 2.5)]


def test_histories_and_subsets(spark):
    e = _events(spark)
    assert [r["seq"] for r in ev.event_history(e, 2).collect()] == [12, 11]
    assert ev.event_subset(e, "task_failed").count() == 1
    samples = spark.createDataFrame([(i, "a", "m", None, float(i)) for i in range(5)],
                                    "seq long, agent_id string, metric string, ts timestamp, value double")
    assert sorted(r["seq"] for r in mt.bounded_history(samples, ["agent_id", "metric"], 2).collect()) == [3, 4]


def test_status_row_and_details(spark):
    agents = spark.createDataFrame([(1, "w", "worker", ["x"], "idle", 0.0),
                                    (2, "v", "worker", ["x", "y"], "error", 0.2)], AGENT_SCHEMA)
    log = spark.createDataFrame([(1, 1, 9, "request"), (2, 5, 9, "request"), (3, 2, 9, "release")],
                                "seq long, resource_id long, agent_id long, action string")
    tracked = rsc.tracked_resources(log, spark.createDataFrame([(1, 2), (2, 1)], "resource_id long, max_concurrent int"))
    closed = tk.apply_completions(_tasks(spark), _events(spark))
    st = rp.system_status(_events(spark), _tasks(spark), agents, tracked, closed).collect()[0].asDict()
    assert st == {"registered_agents": 2, "active_agents": 1, "events_processed": 3,
                  "tasks_completed": 2, "queued_tasks": 3, "active_tasks": 1, "completed_tasks": 2,
                  "failed_tasks": 1, "resources_tracked": 1, "uptime_seconds": 30.0, "tasks_closed": 1,
                  "idle_agents": 1, "busy_agents": 0, "execution_samples": 1, "tasks_failed": 1,
                  "mean_execution_time": Decimal("2.5"), "queue_low": st["queue_low"], "queue_medium": st["queue_medium"],
                  "queue_high": st["queue_high"], "queue_critical": st["queue_critical"]}
    assert sum(v for k, v in st.items() if k.startswith("queue_")) == 3
    det = {r["agent_id"]: r for r in ag.agent_details(agents, _events(spark)).collect()}
    assert det["w"]["last_heartbeat"] == "2024-01-01T00:02:10.000000" and det["v"]["last_heartbeat"] is None
    assert det["v"]["capabilities"] == "x, y" and det["v"]["n_capabilities"] == 2


def test_chart_tables_and_top_lists(spark):
    docs = spark.createDataFrame([(i, " if " * (i * 4)) for i in range(1, 6)], "doc_id long, text string")
    met = cp.code_metrics(docs)
    hist = dict(rows(rp.complexity_histogram(met), "bucket", "documents"))
    assert hist == {0: 2, 1: 2, 2: 1}      # complexity 5, 9, 13, 17, 21
    kpi = rp.quality_kpis(met).collect()[0]
    assert kpi["documents"] == 5 and kpi["clean_documents"] == 5   # complexity is not an issue
    # scores 10, 10, 9, 9, 8: worst is doc 5, then the lower id of the 9.0 tie
    assert [r["doc_id"] for r in cp.worst_files(met, 2).collect()] == [5, 3]
    seen = met.selectExpr("*", "concat('src/f', doc_id, '.py') AS path", "timestamp'2024-03-05 06:07:08' AS ts")
    last = rp.recent_analyses(seen, 2).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["date"], r["file"]) for r in last] == [(4, "03/05 06:07", "f4.py"), (5, "03/05 06:07", "f5.py")]
    trend = rows(rp.event_trend(_events(spark)), "event_type", "n")
    assert trend == [("task_completed", 2), ("task_failed", 1)]
