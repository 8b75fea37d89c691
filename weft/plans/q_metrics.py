"""Catalog entries: metric summaries and histories."""

from weft.operators import metrics as mt
from weft.plans.catalog import query, with_ctes

SUMMARY = """max_by(value, seq) AS current, CAST(avg(value) AS DECIMAL(18,6)) AS average,
       min(value) AS min, max(value) AS max, count(*) AS n"""


@query("agent_metric_stats", with_ctes(["am"], f"""
SELECT agent_id, metric, {SUMMARY} FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id, metric ORDER BY seq DESC) AS rn FROM am)
WHERE rn <= 10 GROUP BY agent_id, metric"""))
def q_agent_metric_stats(m):
    return mt.agent_metric_stats(m.agent_metrics())


@query("bounded_history", with_ctes(["am"], """
SELECT seq, agent_id, metric, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_id, metric ORDER BY seq DESC) AS rn FROM am)
WHERE rn <= 1000"""))
def q_bounded_history(m):
    return mt.bounded_history(m.agent_metrics(), ["agent_id", "metric"], 1000)


@query("system_metric_stats", with_ctes(["sm"], f"""
SELECT metric, {SUMMARY} FROM (SELECT * FROM sm ORDER BY seq DESC LIMIT 1000) GROUP BY metric"""))
def q_system_metric_stats(m):
    return mt.system_metric_stats(m.system_metrics())


@query("uptime_seconds", with_ctes(["ev"], """
SELECT coalesce(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE), 0.0)
       AS uptime_seconds FROM ev"""))
def q_uptime(m):
    return mt.uptime_seconds(m.events())
