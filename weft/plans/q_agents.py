"""Catalog entries: agent-registry operators."""

from pyspark.sql import functions as F

from weft.operators import agents as ag
from weft.plans.catalog import query, with_ctes
from weft.plans.q_events import EFFECT_SQL

CAPS_SQL = """caps AS (SELECT agent_id, reg_seq, state, load_factor, unnest(capabilities) AS capability FROM ag)"""
LEAST_SQL = """pick AS (
  SELECT capability, agent_id FROM (
    SELECT capability, agent_id, row_number() OVER (
             PARTITION BY capability ORDER BY (state <> 'idle'), load_factor, reg_seq) AS rn
    FROM caps) WHERE rn = 1)"""
REGLOG_SQL = """reglog AS (
  SELECT l_suppkey AS agent_id, ((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096) * 4096 + l_suppkey % 4096 AS seq,
         l_partkey % 6 AS capability, l_discount AS load_factor FROM lineitem)"""


def registration_log(m):
    """A registration log with repeats: each lineitem registers its
    supplier with the part's capability (our derivation from testdata)."""
    li = m.raw("lineitem")
    return li.select(F.col("l_suppkey").alias("agent_id"),
                     (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + F.col("l_partkey") % 4096) * 4096
                      + F.col("l_suppkey") % 4096).alias("seq"),
                     (F.col("l_partkey") % 6).alias("capability"),
                     F.col("l_discount").alias("load_factor"))


@query("register_agents", with_ctes([], """
SELECT agent_id, min(seq) AS reg_seq, arg_max(capability, seq) AS capability,
       arg_max(load_factor, seq) AS load_factor, count(*) AS registrations
FROM reglog GROUP BY agent_id""", [REGLOG_SQL]).replace("WITH ,", "WITH "))
def q_register_agents(m):
    return ag.register_agents(registration_log(m))


@query("capable_agents", with_ctes(["ag"], """
SELECT agent_id, state, load_factor FROM ag WHERE list_contains(capabilities, 3)"""))
def q_capable(m):
    return ag.capable_agents(m.agents(), 3).select("agent_id", "state", "load_factor")


@query("idle_agents", with_ctes(["ag"], "SELECT agent_id, state FROM ag WHERE state = 'idle'"))
def q_idle(m):
    return ag.idle_agents(m.agents()).select("agent_id", "state")


@query("active_agents", with_ctes(["ag"], "SELECT agent_id, state FROM ag WHERE state <> 'error'"))
def q_active(m):
    return ag.active_agents(m.agents()).select("agent_id", "state")


@query("capability_match", with_ctes(["tk", "ag"], """
SELECT t.task_id, t.task_type, coalesce(s.n_capable, 0) AS n_capable,
       coalesce(s.n_idle_capable, 0) AS n_idle_capable
FROM tk t LEFT JOIN (SELECT capability, count(*) AS n_capable,
                            count(*) FILTER (WHERE state = 'idle') AS n_idle_capable
                     FROM caps GROUP BY capability) s ON t.task_type = s.capability""", [CAPS_SQL]))
def q_capability_match(m):
    return ag.capability_match(m.tasks(), m.agents())


@query("assign_least_loaded", with_ctes(["tk", "ag"], """
SELECT t.task_id, t.task_type, p.agent_id FROM tk t JOIN pick p ON t.task_type = p.capability""",
                                        [CAPS_SQL, LEAST_SQL]))
def q_assign_least_loaded(m):
    return ag.assign_least_loaded(m.tasks(), m.agents())


@query("assignment_events", with_ctes(["tk", "ag", "ev"], """
SELECT 'task_assigned' AS event_type, 'coordinator' AS source_agent, p.agent_id AS target_agent, t.task_id, t.task_type,
       (SELECT max(ts) FROM ev) AS ts FROM tk t JOIN pick p ON t.task_type = p.capability""", [CAPS_SQL, LEAST_SQL]))
def q_assignment_events(m):
    """The events the assignments publish."""
    return ag.assignment_events(ag.assign_least_loaded(m.tasks(), m.agents()), m.events().select(F.max("ts")).scalar())


@query("assign_first_idle", with_ctes(["tk", "ag"], """
SELECT t.task_id, t.task_type, p.agent_id FROM tk t JOIN (
  SELECT capability, arg_min(agent_id, reg_seq) AS agent_id FROM caps WHERE state = 'idle'
  GROUP BY capability) p ON t.task_type = p.capability""", [CAPS_SQL]))
def q_assign_first_idle(m):
    return ag.assign_first_idle(m.tasks(), m.agents())


@query("unroutable_tasks", with_ctes(["tk", "ag"], """
SELECT task_id, task_type FROM tk WHERE task_type NOT IN (SELECT capability FROM caps)""", [CAPS_SQL]))
def q_unroutable(m):
    return ag.unroutable_tasks(m.tasks(), m.agents())


@query("round_robin", with_ctes(["tk", "ag"], """
SELECT t.task_id, t.task_type, c.agent_id
FROM (SELECT task_id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY seq) AS pos FROM tk) t
JOIN (SELECT capability, count(*) AS n_agents FROM caps GROUP BY capability) n ON t.task_type = n.capability
JOIN (SELECT capability, agent_id, row_number() OVER (PARTITION BY capability ORDER BY reg_seq) - 1 AS slot
      FROM caps) c ON c.capability = t.task_type AND c.slot = (t.pos - 1) % n.n_agents""", [CAPS_SQL]))
def q_round_robin(m):
    return ag.round_robin(m.tasks(), m.agents())


@query("agent_counts", with_ctes(["ag"], """
SELECT count(*) AS registered_agents, count(*) FILTER (WHERE state <> 'error') AS active_agents FROM ag"""))
def q_agent_counts(m):
    return ag.agent_counts(m.agents())


@query("agent_details", with_ctes(["ag", "ev"], """
SELECT a.agent_id, agent_type AS type, state, array_to_string(capabilities, ', ') AS capabilities,
       len(list_distinct(capabilities)) AS n_capabilities, load_factor,
       strftime(b.last_ts, '%Y-%m-%dT%H:%M:%S.%f') AS last_heartbeat, coalesce(b.done, 0) AS tasks_completed,
       CASE WHEN g.task_id NOT IN (SELECT task_id FROM ev WHERE event_type IN ('task_completed', 'task_failed')
                                   AND task_id IS NOT NULL) THEN g.task_id END AS current_task
FROM ag a LEFT JOIN (SELECT source_agent AS agent_id, max(ts) AS last_ts,
                            count(*) FILTER (WHERE event_type = 'task_completed' AND task_id IS NOT NULL) AS done
                     FROM ev GROUP BY source_agent) b
  ON a.agent_id = b.agent_id
LEFT JOIN (SELECT target_agent AS agent_id, arg_max(task_id, seq) AS task_id FROM ev
           WHERE event_type = 'task_assigned' AND task_id IS NOT NULL GROUP BY target_agent) g ON a.agent_id = g.agent_id"""))
def q_agent_details(m):
    return ag.agent_details(m.agents(), m.events())


@query("heartbeat_timeouts", with_ctes(["ev"], """
SELECT * FROM (
  SELECT source_agent AS agent_id, max(ts) AS last_seen,
         CAST(epoch_us((SELECT max(ts) FROM ev)) - epoch_us(max(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)
           AS silence_seconds
  FROM ev GROUP BY source_agent) WHERE silence_seconds > 90"""))
def q_heartbeat(m):
    e = m.events()
    return ag.heartbeat_timeouts(e, e.select(F.max("ts")).scalar())


@query("silence_gaps", with_ctes(["ev"], """
SELECT * FROM (
  SELECT source_agent AS agent_id, lag(ts) OVER w AS last_seen, ts AS returned_at,
         CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS silence_seconds
  FROM ev WINDOW w AS (PARTITION BY source_agent ORDER BY seq))
WHERE last_seen IS NOT NULL AND silence_seconds > 90"""))
def q_silence_gaps(m):
    return ag.silence_gaps(m.events())


@query("heartbeat_alerts_registered", with_ctes(["ev", "ag"], f"""
SELECT * FROM (
  SELECT e.source_agent AS agent_id, max(e.ts) AS last_seen,
         CAST(epoch_us((SELECT max(ts) FROM ev)) - epoch_us(max(e.ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE)
           AS silence_seconds
  FROM ev e WHERE e.source_agent IN (SELECT agent_id FROM st WHERE state <> 'error')
  GROUP BY e.source_agent) WHERE silence_seconds > 90""", [f"""st AS (
  SELECT a.agent_id, coalesce(l.effect, a.state) AS state
  FROM ag a LEFT JOIN (
    SELECT agent_id, arg_max(effect, seq) AS effect
    FROM (SELECT source_agent AS agent_id, seq, {EFFECT_SQL} AS effect
          FROM ev WHERE source_agent IN (SELECT agent_id FROM ag))
    WHERE effect IS NOT NULL GROUP BY agent_id) l ON a.agent_id = l.agent_id)"""]))
def q_heartbeat_registered(m):
    """T3 batch form as the monitor applies it: registered agents whose
    final state is not error, silent for more than 90 s at the last event."""
    from weft.operators import events as evo
    e = m.events()
    states = evo.agent_state(e, m.agents())
    return ag.heartbeat_timeouts(e, e.select(F.max("ts")).scalar(), states=states)
