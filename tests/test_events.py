from pyspark.sql import functions as F

from conftest import rows
from fixtures import AGENT_SCHEMA, EVENT_SCHEMA, event
from weft.operators import events as ev


def _agents(spark):
    return spark.createDataFrame([
        (1, "a", "w", ["x"], "idle", 0.0),
        (2, "b", "w", ["x"], "idle", 0.9),
        (3, "c", "w", ["y"], "busy", 0.5),
    ], AGENT_SCHEMA)


def _events(spark):
    return spark.createDataFrame([
        event(1, "agent_state_changed", "a", new_state="busy"),
        event(2, "task_completed", "a", task_id="t1"),
        event(3, "task_completed", "a", task_id="t1"),          # duplicate completion
        event(4, "task_completed", "a"),                         # no task id: no effect
        event(5, "agent_state_changed", "b", new_state="busy"),  # 0.9 -> 1.0
        event(6, "agent_state_changed", "b", new_state="busy"),  # capped at 1.0
        event(7, "agent_state_changed", "c", new_state="unresponsive"),
        event(8, "task_failed", "zz", task_id="t9"),             # unknown agent
        event(9, "agent_state_changed", "a", new_state="registered", t=9),
        event(10, "agent_state_changed", "b", new_state="idle", t=9),  # same ts, later seq
    ], EVENT_SCHEMA)


def test_event_counts_rollup(spark):
    got = dict((r["metric"], r["n"]) for r in ev.event_counts(_events(spark)).collect())
    assert got == {"event_agent_state_changed": 6, "event_task_completed": 3,
                   "event_task_failed": 1, "total_events": 10}


def test_counts_on_empty_log(spark):
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    got = ev.event_counts(empty).collect()
    assert [(r["metric"], r["n"]) for r in got] == [("total_events", 0)]


def test_agent_state_quirks(spark):
    got = dict(rows(ev.agent_state(_events(spark), _agents(spark)), "agent_id", "state"))
    # a: completion -> idle, 'registered' is no effect; b: idle (seq 10 after seq 6)
    # c: unresponsive -> error
    assert got == {"a": "idle", "b": "idle", "c": "error"}


def test_agent_load_clamps(spark):
    got = dict(rows(ev.agent_load(_events(spark), _agents(spark)), "agent_id", "load_tenths"))
    # a: 0 +1 -1 -1 (floored at 0), completion without task id ignored
    assert got == {"a": 0, "b": 10, "c": 5}


def test_failures_count_unknown_agents(spark):
    got = rows(ev.agent_failures(_events(spark)), "source_agent", "failures")
    assert got == [("zz", 1)]


def test_completions_count_duplicates(spark):
    got = rows(ev.agent_completions(_events(spark)), "agent_id", "tasks_completed")
    assert got == [("a", 2), ("zz", 1)]


def test_recent_events_oldest_first_window(spark):
    got = ev.recent_events(_events(spark), 3).collect()
    assert [r["seq"] for r in got] == [8, 9, 10]


def test_fan_out_control_distinct_ids(spark):
    got = ev.fan_out_control(_agents(spark)).collect()
    assert sorted(r["event_id"] for r in got) == ["stop-a", "stop-b", "stop-c"]
    assert {r["target_agent"] for r in got} == {"a", "b", "c"}


def test_log_lines(spark):
    got = dict(rows(ev.event_log_lines(_events(spark)), "seq", "line"))
    assert got[1] == "Event: agent_state_changed from a to all - {'new_state': 'busy'}"
    assert got[2] == "Event: task_completed from a to all - {'task_id': t1}"
    assert got[4] == "Event: task_completed from a to all - {}"


def test_registered_events_semi_join(spark):
    got = ev.registered_events(_events(spark), _agents(spark))
    assert got.where(F.col("source_agent") == "zz").count() == 0
    assert got.count() == 9
