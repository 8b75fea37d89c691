"""Agent-registry operators: matching, assignment, counts, details.

Capabilities are matched by exploding each agent's (distinct) capability
array once and equi-joining on the capability, so no (task, agent) pair
list is ever produced; per-capability choices are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.scalar import iso_text, seconds_between
from weft.plans.ordered import previous_within, rank_within

IDLE, BUSY, ERROR = "idle", "busy", "error"
HEARTBEAT_TIMEOUT_S = 90.0


def register_agents(log: DataFrame, key: str = "agent_id", seq: str = "seq") -> DataFrame:
    """Upsert a registration log by id. The last registration's
    attributes win; the first registration fixes the position ``reg_seq``.
    Both are partial aggregates (hot ids reduce map-side)."""
    attrs = [c for c in log.columns if c not in (key, seq)]
    return (log.groupBy(key)
            .agg(F.max_by(F.struct(*attrs), seq).alias("a"), F.min(seq).alias("reg_seq"),
                 F.count(F.lit(1)).alias("registrations"))
            .select(key, "reg_seq", "a.*", "registrations"))


def registration_events(log: DataFrame, key: str = "agent_id", seq: str = "seq") -> DataFrame:
    """Every registration also emits one state-change event."""
    return log.select(F.col(seq).alias("seq"), F.lit("agent_state_changed").alias("event_type"),
                      F.col(key).alias("source_agent"), F.lit("registered").alias("new_state"))


def capable_agents(agents: DataFrame, task_type) -> DataFrame:
    """Agents that list ``task_type`` among their capabilities."""
    return agents.where(F.array_contains("capabilities", task_type))


def idle_agents(agents: DataFrame) -> DataFrame:
    """Agents whose state is idle."""
    return agents.where(F.col("state") == IDLE)


def active_agents(agents: DataFrame) -> DataFrame:
    """Agents not in the error state."""
    return agents.where(F.col("state") != ERROR)


def agent_capabilities(agents: DataFrame) -> DataFrame:
    """One row per (agent, distinct capability)."""
    return agents.select("agent_id", "reg_seq", "state", "load_factor",
                         F.explode(F.array_distinct("capabilities")).alias("capability"))


def capability_summary(agents: DataFrame) -> DataFrame:
    """Per capability: number of capable agents and of idle capable agents."""
    return agent_capabilities(agents).groupBy("capability").agg(
        F.count(F.lit(1)).alias("n_capable"),
        F.count_if(F.col("state") == IDLE).alias("n_idle_capable"))


def capability_match(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """For each task, how many agents can take it and how many of those
    are idle. Equi-join of tasks to a per-capability summary (one row per
    capability) instead of the task x agent pair list."""
    s = capability_summary(agents)
    j = tasks.select("task_id", "task_type").join(
        s, tasks["task_type"] == s["capability"], "left")
    return j.select("task_id", "task_type",
                    F.coalesce("n_capable", F.lit(0)).alias("n_capable"),
                    F.coalesce("n_idle_capable", F.lit(0)).alias("n_idle_capable"))


def least_loaded_per_capability(agents: DataFrame) -> DataFrame:
    """Chosen agent per capability: idle candidates first, else any capable
    agent; lowest load; ties to the first registered. An aggregate
    (``min_by`` over a struct key), so it runs once per capability."""
    c = agent_capabilities(agents)
    key = F.struct((F.col("state") != IDLE).alias("not_idle"), "load_factor", "reg_seq")
    return c.groupBy("capability").agg(F.min_by("agent_id", key).alias("agent_id"))


def assign_least_loaded(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Each routable task with its chosen agent."""
    pick = least_loaded_per_capability(agents)
    return (tasks.select("task_id", "task_type")
            .join(pick, tasks["task_type"] == pick["capability"], "inner")
            .select("task_id", "task_type", "agent_id"))


def assignment_events(assigned: DataFrame, as_of: Column) -> DataFrame:
    """The TASK_ASSIGNED event each assignment publishes, to the agent
    chosen, at ``as_of``."""
    return assigned.select(F.lit("task_assigned").alias("event_type"), F.lit("coordinator").alias("source_agent"),
                           F.col("agent_id").alias("target_agent"), "task_id", "task_type", as_of.alias("ts"))


def assign_first_idle(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """J3 (simple coordinator): the first registered idle agent with the
    capability; tasks with none are left out (the reference raises)."""
    c = agent_capabilities(agents).where(F.col("state") == IDLE)
    pick = c.groupBy("capability").agg(F.min_by("agent_id", "reg_seq").alias("agent_id"))
    return (tasks.select("task_id", "task_type")
            .join(pick, tasks["task_type"] == pick["capability"], "inner")
            .select("task_id", "task_type", "agent_id"))


def unroutable_tasks(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks no registered agent can handle (left anti join)."""
    caps = agent_capabilities(agents).select(F.col("capability").alias("task_type")).distinct()
    return tasks.select("task_id", "task_type").join(caps, "task_type", "left_anti")


def round_robin(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Spread each task type's tasks over its capable agents in turn.
    Task position within a type and agent position within a capability
    both come from :func:`rank_within`, so a hot type or a capability held
    by most agents stays parallel."""
    c = rank_within(agent_capabilities(agents).select("agent_id", "reg_seq", "capability"),
                    ["capability"], "reg_seq", name="pos")
    c = c.withColumn("slot", F.col("pos") - 1)
    n = c.groupBy("capability").agg(F.count(F.lit(1)).alias("n_agents"))
    t = rank_within(tasks.select("task_id", "seq", "task_type"), ["task_type"], "seq", name="pos")
    t = t.join(n, t["task_type"] == n["capability"], "inner").drop("capability")
    t = t.withColumn("slot", F.pmod(F.col("pos") - 1, F.col("n_agents")))
    return (t.join(c.select("capability", "slot", "agent_id"),
                   (t["task_type"] == c["capability"]) & (t["slot"] == c["slot"]), "inner")
            .select("task_id", "task_type", "agent_id"))


def agent_counts(agents: DataFrame) -> DataFrame:
    """A5: registered and active (not error) agents."""
    return agents.agg(F.count(F.lit(1)).alias("registered_agents"),
                      F.count_if(F.col("state") != ERROR).alias("active_agents"))


def agent_details(agents: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row per agent with the report fields; capabilities as text.
    With ``events``, ``last_heartbeat`` is the ISO time of the agent's last
    event (any event is a heartbeat; null without one), ``tasks_completed``
    counts its completion events, and ``current_task`` is the last task
    assigned to it, unless that task has ended."""
    out = agents.select(
        "agent_id", F.col("agent_type").alias("type"), "state",
        F.array_join(F.transform("capabilities", lambda x: x.cast("string")), ", ")
        .alias("capabilities"),
        F.size(F.array_distinct("capabilities")).cast("bigint").alias("n_capabilities"),
        "load_factor")
    if events is None:
        return out
    beats = (events.groupBy(F.col("source_agent").alias("agent_id"))
             .agg(iso_text(F.max("ts")).alias("last_heartbeat")))
    ended = F.col("event_type").isin("task_completed", "task_failed") & F.col("task_id").isNotNull()
    given = (events.where((F.col("event_type") == "task_assigned") & F.col("task_id").isNotNull())
             .groupBy(F.col("target_agent").alias("agent_id")).agg(F.max_by("task_id", "seq").alias("current_task")))
    over = events.where(ended).select(F.col("task_id").alias("current_task")).distinct()
    given = given.join(over, "current_task", "left_anti")
    done = (events.where((F.col("event_type") == "task_completed") & F.col("task_id").isNotNull())
            .groupBy(F.col("source_agent").alias("agent_id")).agg(F.count(F.lit(1)).alias("tasks_completed")))
    return (out.join(beats, "agent_id", "left").join(done, "agent_id", "left").join(given, "agent_id", "left")
            .withColumn("tasks_completed", F.coalesce("tasks_completed", F.lit(0).cast("bigint"))))


def heartbeat_timeouts(events: DataFrame, as_of: Column,
                       timeout_s: float = HEARTBEAT_TIMEOUT_S,
                       states: DataFrame | None = None) -> DataFrame:
    """T3 batch form: agents whose last event (any event counts as a
    heartbeat) is more than ``timeout_s`` before ``as_of`` (strict ``>``, on
    microseconds). ``as_of`` is a parameter column, never the wall clock.

    With ``states`` (``agent_id, state``, e.g. from :func:`agent_state`)
    only registered agents not already in error are reported, as the
    monitor skips agents in the error state."""
    last = (events.groupBy(F.col("source_agent").alias("agent_id"))
            .agg(F.max("ts").alias("last_seen")))
    if states is not None:
        last = last.join(states.where(F.col("state") != ERROR).select("agent_id"),
                         "agent_id", "left_semi")
    silence = seconds_between(F.col("last_seen"), as_of)
    return (last.withColumn("silence_seconds", silence)
            .where(F.col("silence_seconds") > timeout_s))


def silence_gaps(events: DataFrame, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """T3 gap rule in batch: one alert for every silence longer than
    ``timeout_s`` between consecutive events of an agent (by ``seq``). The
    previous event comes from :func:`previous_within`, so a hot agent is
    not sorted in one task."""
    e = events.select(F.col("source_agent").alias("agent_id"), "seq", "ts")
    p = previous_within(e, ["agent_id"], "seq", ["ts"])
    gap = seconds_between(F.col("prev_ts"), F.col("ts"))
    return (p.where(F.col("prev_ts").isNotNull())
            .select("agent_id", F.col("prev_ts").alias("last_seen"),
                    F.col("ts").alias("returned_at"), gap.alias("silence_seconds"))
            .where(F.col("silence_seconds") > timeout_s))
