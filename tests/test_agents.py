from pyspark.sql import functions as F

from conftest import rows
from fixtures import AGENT_SCHEMA, TASK_SCHEMA, task
from weft.operators import agents as ag


def _agents(spark):
    return spark.createDataFrame([
        (1, "a1", "w", ["x", "x"], "busy", 0.1),       # repeated capability
        (2, "a2", "w", ["x"], "idle", 0.5),
        (3, "a3", "w", ["x", "y"], "idle", 0.5),       # equal load, registered later
        (4, "a4", "w", ["y"], "error", 0.0),
        (5, "a5", "w", ["z"], "busy", 0.3),            # all z-capable agents busy
        (6, "a6", "w", ["z"], "busy", 0.2),
    ], AGENT_SCHEMA)


def _tasks(spark):
    return spark.createDataFrame([task(i, f"t{i}", tt, 2, [], "pending")
                                  for i, tt in enumerate(["x", "y", "z", "w", "x"])],
                                 TASK_SCHEMA)


def test_least_loaded_prefers_idle_then_load_then_registration(spark):
    got = dict(rows(ag.assign_least_loaded(_tasks(spark), _agents(spark)), "task_id", "agent_id"))
    assert got == {"t0": "a2", "t4": "a2", "t1": "a3", "t2": "a6"}


def test_first_idle_and_unroutable(spark):
    got = dict(rows(ag.assign_first_idle(_tasks(spark), _agents(spark)), "task_id", "agent_id"))
    assert got == {"t0": "a2", "t4": "a2", "t1": "a3"}
    assert rows(ag.unroutable_tasks(_tasks(spark), _agents(spark)), "task_id") == [("t3",)]


def test_capability_match_counts_distinct_capabilities(spark):
    got = {r[0]: (r[1], r[2]) for r in rows(
        ag.capability_match(_tasks(spark), _agents(spark)), "task_id", "n_capable", "n_idle_capable")}
    assert got["t0"] == (3, 2) and got["t3"] == (0, 0) and got["t2"] == (2, 0)


def test_round_robin_spreads(spark):
    got = rows(ag.round_robin(_tasks(spark), _agents(spark)), "task_id", "agent_id")
    assert dict(got)["t0"] == "a1" and dict(got)["t4"] == "a2"


def test_counts_and_filters(spark):
    a = _agents(spark)
    assert ag.agent_counts(a).collect()[0].asDict() == {"registered_agents": 6, "active_agents": 5}
    assert ag.idle_agents(a).count() == 2
    assert ag.capable_agents(a, "y").count() == 2


def test_register_agents_last_write_wins_first_position_kept(spark):
    log = spark.createDataFrame([("a", 5, "x", 0.1), ("b", 6, "y", 0.2), ("a", 9, "z", 0.3)],
                                "agent_id string, seq long, capability string, load double")
    got = rows(ag.register_agents(log), "agent_id", "reg_seq", "capability", "registrations")
    assert got == [("a", 5, "z", 2), ("b", 6, "y", 1)]
    assert ag.registration_events(log).where(F.col("new_state") == "registered").count() == 3
