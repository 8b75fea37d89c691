"""Catalog entries: Structured Streaming twins, run with an availableNow
trigger over the event table's folder and read back from their batch
output. Their oracles are the batch semantics in SQL."""

from pyspark.sql import functions as F

from weft.operators import events as ev
from weft.plans.catalog import ORACLE, query, with_ctes
from weft.plans.q_events import EFFECT_SQL
from weft.plans.q_resources import ADMISSION_SQL
from weft.plans.q_tasks import CLOSED_SQL, FIRST_TERMINAL_SQL
from weft.sources.adapters import coordination_events, model_events, model_resource_log
from weft.streaming import queries as sq
from weft.streaming import stateful as S
from weft.streaming.sources import (latest_per_key, read_batches, run_batches, run_observers,
                                    table_stream, with_event_time)


FILES = 16  # part files a micro-batch takes, so that a key's rows of a batch stay bounded


def _events(m, event_time=False):
    e = model_events(table_stream(m.spark, m.sf_dir, "events", max_files_per_trigger=FILES))
    return with_event_time(e) if event_time else e


@query("stream_event_counts", with_ctes(["ev"], """
SELECT event_type, count(*) AS n FROM ev GROUP BY event_type"""))
def q_stream_event_counts(m):
    """T1 (update mode); final value per type."""
    out = run_batches(sq.stream_event_counts(_events(m)), "event_counts", "update")
    return latest_per_key(read_batches(m.spark, out, "event_type string, n long"), ["event_type"])


@query("stream_agent_state", with_ctes(["ev", "ag"], f"""
SELECT a.agent_id, coalesce(st.effect, a.state) AS state, ld.tenths AS load_tenths, st.last_seq
FROM ag a
JOIN (SELECT source_agent AS agent_id, max(seq) AS last_seq,
             arg_max({EFFECT_SQL}, seq) FILTER (WHERE {EFFECT_SQL} IS NOT NULL) AS effect
      FROM ev GROUP BY source_agent) st ON st.agent_id = a.agent_id
JOIN (SELECT a.agent_id,
             list_reduce(coalesce(list(s.d ORDER BY s.seq) FILTER (WHERE s.d IS NOT NULL), []),
                         lambda acc, x: least(10, greatest(0, acc + x)),
                         CAST(round(a.load_factor * 10) AS BIGINT)) AS tenths
      FROM ag a LEFT JOIN (
        SELECT source_agent AS agent_id, seq,
               CASE WHEN event_type = 'agent_state_changed' AND new_state = 'busy' THEN 1
                    WHEN event_type = 'task_completed' AND task_id IS NOT NULL THEN -1 END AS d
        FROM ev) s ON s.agent_id = a.agent_id
      GROUP BY a.agent_id, a.load_factor) ld ON ld.agent_id = a.agent_id"""))
def q_stream_agent_state(m):
    """Running agent state and load; final row per agent."""
    out = run_batches(sq.stream_agent_state(_events(m), m.agents()), "agent_state", "update")
    return latest_per_key(read_batches(m.spark, out, S.AGENT_OUT), ["agent_id"])


@query("stream_heartbeat_alerts", with_ctes(["ev"], """
SELECT agent_id, last_seen, kind FROM (
  SELECT source_agent AS agent_id, lag(ts) OVER w AS last_seen, 'gap' AS kind,
         epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
  FROM ev WINDOW w AS (PARTITION BY source_agent ORDER BY seq))
WHERE last_seen IS NOT NULL AND gap_us > 90000000
UNION ALL
SELECT source_agent AS agent_id, max(ts) AS last_seen, 'open' AS kind FROM ev GROUP BY source_agent
HAVING epoch_us((SELECT max(ts) FROM ev)) // 1000 * 1000 - epoch_us(max(ts)) > 90000000"""))
def q_stream_heartbeat(m):
    """Gap alerts plus open silences closed by the final watermark."""
    out = run_batches(sq.stream_heartbeat_alerts(_events(m, event_time=True)), "heartbeat")
    df = read_batches(m.spark, out, sq.HEARTBEAT_ALERTS)
    return df.select("agent_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "kind")


@query("stream_heartbeat_registered", with_ctes(["ev", "ag"], f"""
SELECT agent_id, last_seen, 'gap' AS kind FROM gaps
WHERE last_seen IS NOT NULL AND gap_us > 90000000 AND state_before <> 'error'
UNION ALL
SELECT agent_id, max(ts), 'open' FROM gaps GROUP BY agent_id
HAVING epoch_us((SELECT max(ts) FROM ev)) // 1000 * 1000 - epoch_us(max(ts)) > 90000000
   AND arg_max(state_after, seq) <> 'error'""", [f"""folded AS (
  SELECT a.agent_id, e.seq, e.ts, a.state, {EFFECT_SQL} AS effect
  FROM ag a JOIN ev e ON e.source_agent = a.agent_id),
gaps AS (
  SELECT agent_id, seq, ts, lag(ts) OVER w AS last_seen, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us,
         coalesce(last_value(effect IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), state) AS state_before,
         coalesce(last_value(effect IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), state) AS state_after
  FROM folded WINDOW w AS (PARTITION BY agent_id ORDER BY seq))"""]))
def q_stream_heartbeat_registered(m):
    """T3 as the monitor applies it: registered agents that are not in error."""
    stream = sq.stream_heartbeat_alerts(_events(m, event_time=True), agents=m.agents())
    df = read_batches(m.spark, run_batches(stream, "heartbeat_registered"), sq.HEARTBEAT_ALERTS)
    return df.select("agent_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "kind")


# Events after an agent's first registration; what each leaves behind is its
# effect, or the error of the silence it ends.
KNOWN_SQL = """known AS (
  SELECT agent_id, seq, ts, new_state, event_type, task_id, heard, silent, effect,
         coalesce(effect, CASE WHEN silent THEN 'error' END) AS after FROM (
    SELECT *, coalesce(epoch_us(ts) - epoch_us(heard) > 90000000, false) AS silent,
           CASE WHEN new_state IN ('registered', 'idle') OR event_type = 'task_completed' THEN 'idle'
                WHEN new_state = 'busy' THEN 'busy' WHEN event_type = 'task_failed' THEN 'error' END AS effect FROM (
      SELECT source_agent AS agent_id, e.*, max(ts) OVER (PARTITION BY source_agent ORDER BY seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heard
      FROM cev e WHERE seq >= (SELECT min(r.seq) FROM cev r WHERE r.source_agent = e.source_agent AND r.new_state = 'registered')))),
folded AS (
  SELECT *, last_value(after IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before,
         last_value(after IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state_after
  FROM known),
final AS (
  SELECT agent_id, max(ts) AS last_seen, max(seq) AS last_seq, arg_max(state_after, seq) AS state,
         max(seq) FILTER (new_state = 'registered') AS since,
         epoch_us((SELECT max(ts) FROM cev)) // 1000 * 1000 - epoch_us(max(ts)) > 90000000 AS open
  FROM folded GROUP BY agent_id)"""


def _coordination(m):
    stream = sq.stream_coordination(with_event_time(coordination_events(
        table_stream(m.spark, m.sf_dir, "events", max_files_per_trigger=FILES))))
    return read_batches(m.spark, run_batches(stream, "coordination", "update"), sq.COORDINATION)


@query("stream_silence_alerts", with_ctes(["cev"], """
SELECT agent_id, heard AS last_seen FROM folded WHERE silent AND state_before <> 'error'
UNION ALL SELECT agent_id, last_seen FROM final WHERE open AND state <> 'error'""", [KNOWN_SQL]))
def q_stream_silence_alerts(m):
    """S11 + T3: agents that register midway, some of which never speak; every
    silence of a known agent once."""
    df = _coordination(m).where("kind = 'silence'")
    return df.select("agent_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("stream_registered_state", with_ctes(["cev"], """
SELECT f.agent_id, CASE WHEN open THEN 'error' ELSE state END AS state, last_seq, last_seen,
       CAST(list_reduce(list_prepend(0, coalesce(list(CASE WHEN k.new_state = 'busy' THEN 1 ELSE -1 END ORDER BY k.seq)
              FILTER (k.seq > since AND (k.new_state = 'busy' OR k.event_type = 'task_completed')), [])),
            lambda acc, x: least(10, greatest(0, acc + x))) AS BIGINT) AS load_tenths
FROM final f JOIN folded k ON k.agent_id = f.agent_id GROUP BY f.agent_id, open, state, last_seq, last_seen""", [KNOWN_SQL]))
def q_stream_registered_state(m):
    """S11 + T2: last state and load of each agent, from its last registration on."""
    return sq.latest_agent_states(_coordination(m)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("stream_resource_admission", "WITH RECURSIVE " + with_ctes(["rl", "rs"], "SELECT * FROM adm",
                                                                 [ADMISSION_SQL])[5:])
def q_stream_admission(m):
    """T4: per-resource admission in keyed state."""
    log = model_resource_log(table_stream(m.spark, m.sf_dir, "events", max_files_per_trigger=FILES))
    out = run_batches(sq.stream_resource_admission(log, m.resources()), "admission")
    return read_batches(m.spark, out, S.ADMISSION_OUT).drop("batch_id")


@query("stream_task_lifecycle", with_ctes(["ev", "tk"], """
SELECT task_id, 'running' AS status, given AS seq, given_at AS started_at FROM life WHERE status = 'pending' AND given IS NOT NULL
UNION ALL
SELECT task_id, how, ended, CASE WHEN status = 'pending' THEN given_at END FROM life
WHERE ended IS NOT NULL AND (status = 'running' OR given IS NOT NULL)""", ["""given AS (
  SELECT task_id, min(seq) AS given, arg_min(ts, seq) AS given_at FROM ev
  WHERE event_type = 'task_assigned' AND task_id IS NOT NULL GROUP BY task_id),
life AS (
  SELECT t.task_id, t.status, g.given, g.given_at, min(e.seq) AS ended,
         CASE arg_min(e.event_type, e.seq) WHEN 'task_failed' THEN 'failed' ELSE 'completed' END AS how
  FROM tk t LEFT JOIN given g ON t.task_id = g.task_id
  LEFT JOIN ev e ON e.task_id = t.task_id AND e.event_type IN ('task_completed', 'task_failed')
            AND (t.status = 'running' OR e.seq > g.given)
  WHERE t.status IN ('pending', 'running') GROUP BY t.task_id, t.status, g.given, g.given_at)"""]))
def q_stream_lifecycle(m):
    """T5: every status change the stream makes."""
    out = run_batches(sq.stream_task_lifecycle(_events(m), m.tasks()), "lifecycle")
    df = read_batches(m.spark, out, sq.LIFECYCLE).drop("batch_id")
    return df.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


WINDOWED = """wb AS (
  SELECT *, make_timestamp(epoch_us(ts) // 30000000 * 30000000) AS window_start FROM ev),
closed_w AS (
  SELECT * FROM wb WHERE epoch_us(window_start) + 30000000
                         <= epoch_us((SELECT max(ts) FROM ev)) // 1000 * 1000)"""


@query("tumbling_event_counts", with_ctes(["ev"], """
SELECT window_start, event_type, count(*) AS n FROM closed_w GROUP BY window_start, event_type""",
                                          [WINDOWED]))
def q_tumbling(m):
    """30 s tumbling counts, append mode (windows the watermark closed)."""
    out = run_batches(sq.tumbling_event_counts(_events(m, event_time=True)), "tumbling")
    df = read_batches(m.spark, out, "window_start timestamp, event_type string, n long")
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                     "event_type", "n")


@query("window_alerts", with_ctes(["ev"], """
SELECT window_start, events, errors, error_alert, latency_alert FROM (
  SELECT window_start, count(*) AS events, count(*) FILTER (WHERE event_type = 'task_failed') AS errors,
         CAST(count(*) FILTER (WHERE event_type = 'task_failed') AS DOUBLE) / CAST(count(*) AS DOUBLE) > 0.05
           AS error_alert,
         coalesce(max(execution_time) * 1000.0 > 5000.0, false) AS latency_alert
  FROM closed_w GROUP BY window_start) WHERE error_alert OR latency_alert""", [WINDOWED]))
def q_window_alerts(m):
    """Alert windows (error share, slowest execution)."""
    out = run_batches(sq.window_alerts(_events(m, event_time=True)), "alerts")
    df = read_batches(m.spark, out, "window_start timestamp, events long, errors long, "
                      "error_alert boolean, latency_alert boolean")
    return df.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                     "events", "errors", "error_alert", "latency_alert")


def _write_batch(df, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


@query("stream_event_log", ORACLE["event_log_lines"])
def q_stream_event_log(m):
    """T8 + S7: events streamed to two observers (log lines, running counts)
    through the isolating fan-out; the log lines are read back."""
    observers = {
        "lines": lambda b, i, f: _write_batch(ev.event_log_lines(b), f, i),
        "counts": lambda b, i, f: _write_batch(ev.event_counts(b), f, i),
    }
    errors: dict = {}
    base = run_observers(_events(m), observers, "event_log", errors=errors)
    if errors:
        raise RuntimeError(f"observer failures: {errors}")
    return m.spark.read.parquet(f"{base}/lines").drop("batch_id")
