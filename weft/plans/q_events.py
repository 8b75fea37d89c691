"""Catalog entries: event log operators."""

from weft.operators import events as ev
from weft.plans.catalog import query, with_ctes

EFFECT_SQL = """CASE WHEN event_type = 'task_completed' AND task_id IS NOT NULL THEN 'idle'
            WHEN event_type = 'task_failed' AND task_id IS NOT NULL THEN 'error'
            WHEN event_type = 'agent_state_changed' AND new_state = 'busy' THEN 'busy'
            WHEN event_type = 'agent_state_changed' AND new_state = 'idle' THEN 'idle'
            WHEN event_type = 'agent_state_changed' AND new_state = 'unresponsive' THEN 'error' END"""


@query("event_counts", with_ctes(["ev"], """
SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'total_events' ELSE 'event_' || event_type END AS metric,
       count(*) AS n
FROM ev GROUP BY ROLLUP (event_type)"""))
def q_event_counts(m):
    """A1 over the whole event log."""
    return ev.event_counts(m.events())


@query("agent_failures", with_ctes(["ev"], """
SELECT source_agent, count(*) AS failures FROM ev
WHERE event_type = 'task_failed' AND task_id IS NOT NULL GROUP BY source_agent"""))
def q_agent_failures(m):
    return ev.agent_failures(m.events())


@query("agent_completions", with_ctes(["ev"], """
SELECT source_agent AS agent_id, count(*) AS tasks_completed,
       count(*) FILTER (WHERE event_type = 'task_completed') AS tasks_succeeded,
       count(*) FILTER (WHERE event_type = 'task_failed') AS tasks_failed
FROM ev WHERE event_type IN ('task_completed', 'task_failed') AND task_id IS NOT NULL
GROUP BY source_agent"""))
def q_agent_completions(m):
    return ev.agent_completions(m.events())


@query("registered_events", with_ctes(["ev", "ag"], """
SELECT * FROM ev WHERE source_agent IN (SELECT agent_id FROM ag)"""))
def q_registered_events(m):
    return ev.registered_events(m.events(), m.agents())


@query("event_subset", with_ctes(["ev"], """
SELECT * FROM ev WHERE event_type = 'task_completed'"""))
def q_event_subset(m):
    return ev.event_subset(m.events(), ev.TASK_COMPLETED)


@query("recent_events", with_ctes(["ev"], """
SELECT seq, ts, event_type AS type, source_agent AS source, target_agent AS target
FROM ev ORDER BY seq DESC LIMIT 10"""))
def q_recent_events(m):
    return ev.recent_events(m.events(), 10)


@query("event_history", with_ctes(["ev"], """
SELECT * FROM ev ORDER BY seq DESC LIMIT 1000"""))
def q_event_history(m):
    return ev.event_history(m.events(), 1000)


@query("agent_state", with_ctes(["ev", "ag"], f"""
SELECT a.agent_id, coalesce(l.effect, a.state) AS state, l.changed_at_seq
FROM ag a LEFT JOIN (
  SELECT agent_id, arg_max(effect, seq) AS effect, max(seq) AS changed_at_seq
  FROM (SELECT source_agent AS agent_id, seq, {EFFECT_SQL} AS effect
        FROM ev WHERE source_agent IN (SELECT agent_id FROM ag))
  WHERE effect IS NOT NULL GROUP BY agent_id) l ON a.agent_id = l.agent_id"""))
def q_agent_state(m):
    return ev.agent_state(m.events(), m.agents())


@query("agent_load", with_ctes(["ev", "ag"], """
SELECT a.agent_id, t.tenths AS load_tenths, CAST(t.tenths AS DOUBLE) / 10 AS load_factor
FROM ag a JOIN (
  SELECT a.agent_id,
         list_reduce(coalesce(list(s.d ORDER BY s.seq) FILTER (WHERE s.d IS NOT NULL), []),
                     lambda acc, x: least(10, greatest(0, acc + x)),
                     CAST(round(a.load_factor * 10) AS BIGINT)) AS tenths
  FROM ag a LEFT JOIN (
    SELECT source_agent AS agent_id, seq,
           CASE WHEN event_type = 'agent_state_changed' AND new_state = 'busy' THEN 1
                WHEN event_type = 'task_completed' AND task_id IS NOT NULL THEN -1 END AS d
    FROM ev) s ON s.agent_id = a.agent_id
  GROUP BY a.agent_id, a.load_factor) t ON a.agent_id = t.agent_id"""))
def q_agent_load(m):
    return ev.agent_load(m.events(), m.agents())


@query("fan_out_control", with_ctes(["ag"], """
SELECT 'stop-' || CAST(agent_id AS VARCHAR) AS event_id, 'emergency_stop' AS event_type,
       'coordinator' AS source_agent, agent_id AS target_agent,
       'Emergency stop requested' AS reason FROM ag"""))
def q_fan_out_control(m):
    return ev.fan_out_control(m.agents())


@query("event_log_lines", with_ctes(["ev"], """
SELECT seq, printf('Event: %s from %s to %s - %s', event_type, CAST(source_agent AS VARCHAR),
                   coalesce(CAST(target_agent AS VARCHAR), 'all'),
                   '{' || concat_ws(', ',
                       CASE WHEN new_state IS NOT NULL THEN '''new_state'': ''' || new_state || '''' END,
                       CASE WHEN task_id IS NOT NULL THEN '''task_id'': ' || CAST(task_id AS VARCHAR) END,
                       CASE WHEN execution_time IS NOT NULL THEN '''execution_time'': ' || CAST(execution_time AS VARCHAR) END,
                       CASE WHEN error IS NOT NULL THEN '''error'': ''' || error || '''' END) || '}') AS line
FROM ev"""))
def q_event_log_lines(m):
    return ev.event_log_lines(m.events())


@query("event_labels", with_ctes(["ev"], """
SELECT metric, n, array_to_string(list_transform(string_split(replace(regexp_replace(metric, '^event_', ''), '_', ' '), ' '),
                                                 lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS label
FROM (SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'total_events' ELSE 'event_' || event_type END AS metric,
             count(*) AS n FROM ev GROUP BY ROLLUP (event_type))"""))
def q_event_labels(m):
    """F2 + F3 on the event counters (display labels)."""
    from pyspark.sql import functions as F
    from weft.functions.scalar import key_label, strip_event_prefix
    c = ev.event_counts(m.events())
    return c.select("metric", "n", key_label(strip_event_prefix(F.col("metric"))).alias("label"))


@query("recent_event_display", with_ctes(["ev"], """
SELECT seq, substring(CAST(seq AS VARCHAR), 1, 8) AS short_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_ts, strftime(ts, '%m/%d %H:%M') AS short_ts,
       event_type FROM ev ORDER BY seq DESC LIMIT 10"""))
def q_recent_event_display(m):
    """K1 with F5, F6, F7 display columns."""
    from pyspark.sql import functions as F
    from weft.functions.scalar import iso_text, short_date, short_id
    r = ev.event_history(m.events(), 10)
    return r.select("seq", short_id(F.col("seq")).alias("short_id"), iso_text(F.col("ts")).alias("iso_ts"),
                    short_date(F.col("ts")).alias("short_ts"), "event_type")
