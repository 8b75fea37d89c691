"""Catalog entries: reports, analyzer union, history, memory, expiry."""

from pyspark.sql import functions as F

from weft.operators import agents as ag
from weft.operators import corpus as cp
from weft.operators import metrics as mt
from weft.operators import reports as rp
from weft.operators import resources as rsc
from weft.plans.catalog import ORACLE, query, with_ctes
from weft.plans import q_agents, q_metrics  # noqa: F401  (their oracles are parts of the report's)
from weft.plans.q_corpus import METRICS_SQL
from weft.operators import tasks as tk
from weft.plans.q_resources import ADMISSION_SQL
from weft.plans.q_tasks import CLOSED_SQL, FIRST_TERMINAL_SQL


def _metrics_with_path(m):
    docs = m.raw("documents").withColumn(
        "path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return cp.code_metrics(docs, carry=("path",))


@query("system_status", with_ctes(["ev", "tk", "ag", "rl", "rs"], """
SELECT count(*) AS registered_agents, count(*) FILTER (WHERE state <> 'error') AS active_agents,
  count(*) FILTER (WHERE state = 'idle') AS idle_agents, count(*) FILTER (WHERE state = 'busy') AS busy_agents,
  (SELECT count(*) FROM ev) AS events_processed,
  (SELECT count(*) FROM ev WHERE event_type = 'task_completed' AND task_id IS NOT NULL) AS tasks_completed,
  (SELECT count(*) FROM ev WHERE event_type = 'task_failed' AND task_id IS NOT NULL) AS tasks_failed,
  (SELECT count(execution_time) FROM ev) AS execution_samples,
  (SELECT CAST(avg(execution_time) AS DECIMAL(18,6)) FROM ev) AS mean_execution_time,
  (SELECT count(*) FILTER (WHERE status = 'pending') FROM tk) AS queued_tasks,
  (SELECT count(*) FILTER (WHERE status = 'pending' AND priority = 1) FROM tk) AS queue_low,
  (SELECT count(*) FILTER (WHERE status = 'pending' AND priority = 2) FROM tk) AS queue_medium,
  (SELECT count(*) FILTER (WHERE status = 'pending' AND priority = 3) FROM tk) AS queue_high,
  (SELECT count(*) FILTER (WHERE status = 'pending' AND priority = 4) FROM tk) AS queue_critical,
  (SELECT count(*) FILTER (WHERE status = 'running') FROM tk) AS active_tasks,
  (SELECT count(*) FILTER (WHERE status IN ('completed', 'failed')) FROM tk) AS completed_tasks,
  (SELECT count(*) FILTER (WHERE status = 'failed') FROM tk) AS failed_tasks,
  (SELECT count(DISTINCT resource_id) FROM rl WHERE action = 'request'
     AND resource_id IN (SELECT resource_id FROM rs)) AS resources_tracked,
  (SELECT coalesce(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE), 0.0)
   FROM ev) AS uptime_seconds,
  (SELECT count(*) FROM closed) AS tasks_closed
FROM ag""", [FIRST_TERMINAL_SQL, CLOSED_SQL]))
def q_system_status(m):
    closed = tk.apply_completions(m.tasks(), m.events())
    return rp.system_status(m.events(), m.tasks(), m.agents(),
                            rsc.tracked_resources(m.resource_log(), m.resources()), closed)


def _long(section: str, table: str, key: str | None, fields: list[str]) -> str:
    """SQL twin of one part of ``status_report``."""
    cells = ", ".join(f"{{'field': '{c}', 'value': CAST({c} AS VARCHAR)}}" for c in fields)
    item = f"CAST({key} AS VARCHAR)" if key else "'all'"
    return (f"SELECT '{section}' AS section, {item} AS item, f.field AS field, f.value AS value "
            f"FROM (SELECT *, unnest([{cells}]) AS f FROM {table})")


COUNTS = ["registered_agents", "active_agents"]
TASK_COUNTS = ["queued_tasks", "active_tasks", "completed_tasks", "failed_tasks"]
RESOURCE_FIELDS = ["current_users", "max_concurrent", "utilization"]
METRIC_FIELDS = ["current", "average", "min", "max"]
AGENT_FIELDS = ["type", "state", "capabilities", "current_task", "last_heartbeat"]


@query("status_report", "WITH RECURSIVE " + with_ctes(["ev", "tk", "ag", "rl", "rs", "sm"], "\nUNION ALL\n".join([
    _long("agents", "counts", None, COUNTS), _long("tasks", "counts", None, TASK_COUNTS), _long("resource", "used", "resource_id", RESOURCE_FIELDS),
    _long("metric", "metrics_", "metric", METRIC_FIELDS), _long("agent", "details", "agent_id", AGENT_FIELDS)]), [ADMISSION_SQL, """counts AS (
  SELECT (SELECT count(*) FROM ag) AS registered_agents, (SELECT count(*) FROM ag WHERE state <> 'error') AS active_agents,
         count(*) FILTER (WHERE status = 'pending') AS queued_tasks, count(*) FILTER (WHERE status = 'running') AS active_tasks,
         count(*) FILTER (WHERE status IN ('completed', 'failed')) AS completed_tasks, count(*) FILTER (WHERE status = 'failed') AS failed_tasks FROM tk)""",
    f"used AS ({ORACLE['resource_utilization'].split(ADMISSION_SQL)[1]})",
    "metrics_ AS (" + ORACLE["system_metric_stats"].split("FROM events)", 1)[1].lstrip(", \n") + ")",
    "details AS (" + ORACLE["agent_details"][ORACLE["agent_details"].index("SELECT a.agent_id, agent_type"):] + ")"])[5:])
def q_status_report(m):
    """Counts, resources, metrics and agents in one report."""
    a, t = m.agents(), m.tasks()
    res = rsc.resource_utilization(rsc.resource_admission(m.resource_log(), m.resources()), m.resources())
    det = ag.agent_details(a, m.events()).select("agent_id", *AGENT_FIELDS)
    return rp.status_report(agents=(ag.agent_counts(a), None), tasks=(tk.task_stats(t).select(*TASK_COUNTS), None),
                            resource=(res, "resource_id"), metric=(mt.system_metric_stats(m.system_metrics()).select("metric", *METRIC_FIELDS), "metric"),
                            agent=(det, "agent_id"))


def analyzers():
    """Named analyzers over a table of measures: each returns (doc_id, detail)."""
    def detail(text, *cols):
        return lambda d: d.select("doc_id", F.format_string(text, *cols).alias("detail"))
    return {"structure": detail("functions=%d classes=%d", "function_count", "class_count"),
            "complexity": detail("complexity=%d", "complexity"),
            "security": detail("findings=%d", "security_issues")}


def _measured(m):
    """The measures of every document, computed once and written."""
    from weft.sources.tabular import written
    return written(cp.code_metrics(m.raw("documents")), "measures")


COMBINED_SQL = f"""{METRICS_SQL},
combined AS (
  SELECT doc_id, 'structure' AS analyzer, 'ok' AS status,
         printf('functions=%d classes=%d', function_count, class_count) AS detail,
         CAST(NULL AS VARCHAR) AS error FROM metrics
  UNION ALL
  SELECT doc_id, 'complexity', 'ok', printf('complexity=%d', complexity), NULL FROM metrics
  UNION ALL
  SELECT doc_id, 'security', 'ok', printf('findings=%d', security_issues), NULL FROM metrics)"""


@query("combine_analyzers", f"WITH {COMBINED_SQL} SELECT * FROM combined")
def q_combine(m):
    return rp.combine_analyzers(_measured(m), analyzers())


@query("analyzers_run", f"""WITH {COMBINED_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(list(analyzer))), ',') AS analyzers
FROM combined WHERE status = 'ok' GROUP BY doc_id""")
def q_analyzers_run(m):
    return rp.analyzers_run(rp.combine_analyzers(_measured(m), analyzers()))


FAILING_SQL = f"""{METRICS_SQL},
combined AS (
  SELECT doc_id, 'structure' AS analyzer, 'ok' AS status,
         printf('functions=%d classes=%d', function_count, class_count) AS detail, false AS failed FROM metrics
  UNION ALL SELECT doc_id, 'broken_plan', 'error', NULL, true FROM metrics
  UNION ALL SELECT doc_id, 'broken_run', 'error', NULL, true FROM metrics)"""


@query("combine_analyzers_failing", f"WITH {FAILING_SQL} SELECT * FROM combined")
def q_combine_failing(m):
    """One analyzer fails when its plan is built, one while it runs;
    both become error rows and the third stands."""
    def broken_run(d):
        return d.select("doc_id", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("no such measure"))).alias("detail"))
    named = {"structure": analyzers()["structure"], "broken_plan": lambda d: d.select("doc_id", "no_such_column"),
             "broken_run": broken_run}
    out = rp.combine_analyzers(_measured(m), named, max_errors=10)
    return out.select("doc_id", "analyzer", "status", "detail", F.col("error").isNotNull().alias("failed"))


LONG_TEXT = 20_000  # code points the strict analyzer below can take


@query("combine_analyzers_bad_rows", f"""WITH {METRICS_SQL}
SELECT doc_id, 'complexity' AS analyzer, 'ok' AS status, printf('complexity=%d', complexity) AS detail, false AS failed FROM metrics
UNION ALL
SELECT doc_id, 'strict', CASE WHEN n_chars > {LONG_TEXT} THEN 'error' ELSE 'ok' END,
       CASE WHEN n_chars <= {LONG_TEXT} THEN 'lines=' || CAST(lines_of_code AS VARCHAR) END, n_chars > {LONG_TEXT}
FROM metrics JOIN documents USING (doc_id)""")
def q_combine_bad_rows(m):
    """An analyzer that raises on long texts fails for these alone."""
    from weft.sources.tabular import written
    docs = written(cp.code_metrics(m.raw("documents"), carry=("n_chars",)), "measures")

    def strict(d):
        too_long = F.raise_error(F.concat(F.lit("text too long: "), F.col("n_chars").cast("string")))
        return d.select("doc_id", F.when(F.col("n_chars") > LONG_TEXT, too_long).otherwise(
            F.concat(F.lit("lines="), F.col("lines_of_code").cast("string"))).alias("detail"))
    out = rp.combine_analyzers(docs, {"complexity": analyzers()["complexity"], "strict": strict}, max_errors=10_000)
    return out.select("doc_id", "analyzer", "status", "detail", F.col("error").isNotNull().alias("failed"))


@query("recent_analyses", f"""WITH {METRICS_SQL}
SELECT doc_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%m/%d %H:%M') AS date,
       CAST(doc_id AS VARCHAR) AS file, quality_score, issues_found, rating,
       CASE WHEN quality_score >= 7 THEN 'success' ELSE 'warning' END AS score_band,
       CASE WHEN issues_found = 0 THEN 'success' ELSE 'danger' END AS issues_band,
       repeat('*', greatest(0, least(CAST(trunc(quality_score) AS INTEGER), 10))) AS stars
FROM metrics ORDER BY doc_id DESC LIMIT 10""")
def q_recent_analyses(m):
    docs = m.raw("documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    docs = docs.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00+00").cast("timestamp"))
                                                    + F.col("doc_id") * 60_000_000))
    return rp.recent_analyses(cp.code_metrics(docs, carry=("path", "ts")), 10)


@query("text_report", f"""WITH {METRICS_SQL}
SELECT doc_id, printf('Analysis Results\n================\nFile: %s\nQuality Score: %s/10\nRating: %s\n\nMetrics:\n- Lines of Code: %s\n- Functions: %s\n- Classes: %s\n- Complexity: %s\n- Security Issues: %s\n\nRecommendations:\n%s',
  coalesce(d.source || '/' || CAST(doc_id AS VARCHAR), 'N/A'), coalesce(CAST(quality_score AS VARCHAR), 'N/A'),
  coalesce(rating, 'N/A'), CAST(lines_of_code AS VARCHAR), CAST(function_count AS VARCHAR),
  CAST(class_count AS VARCHAR), CAST(complexity AS VARCHAR), CAST(security_issues AS VARCHAR),
  array_to_string(list_transform(list_filter(string_split(coalesce(recommendations, ''), '; '),
                                             lambda r: r <> ''), lambda r: '- ' || r), chr(10))) AS report
FROM metrics JOIN documents d USING (doc_id)""".replace("\\n", "' || chr(10) || '"))
def q_text_report(m):
    return rp.text_report(_metrics_with_path(m))


@query("complexity_histogram", f"""WITH {METRICS_SQL}
SELECT CAST(floor(complexity / 10) AS BIGINT) AS bucket, count(*) AS documents,
       CAST(floor(complexity / 10) AS BIGINT) * 10 AS lower_bound
FROM metrics GROUP BY 1""")
def q_complexity_histogram(m):
    return rp.complexity_histogram(cp.code_metrics(m.raw("documents")))


@query("quality_kpis", f"""WITH {METRICS_SQL}
SELECT count(*) AS documents, CAST(avg(quality_score) AS DECIMAL(18,6)) AS average_score,
       count(*) FILTER (WHERE issues_found = 0) AS clean_documents,
       CAST(sum(security_issues) AS BIGINT) AS security_issues FROM metrics""")
def q_quality_kpis(m):
    return rp.quality_kpis(cp.code_metrics(m.raw("documents")))


@query("event_trend", with_ctes(["ev"], """
SELECT date_trunc('day', ts) AS period, event_type, count(*) AS n FROM ev GROUP BY 1, 2"""))
def q_event_trend(m):
    return rp.event_trend(m.events())


@query("exclude_expired", with_ctes(["ev"], """
SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAY"""))
def q_exclude_expired(m):
    e = m.events()
    return rp.exclude_expired(e, e.select(F.max("ts")).scalar(), 7)


@query("memory_episodes", """
SELECT conv_id, turn, text AS content, role AS context_type FROM conversations WHERE role = 'user'""")
def q_memory_episodes(m):
    ep = rp.episodes_of_type(rp.memory_episodes(m.raw("conversations")), "user")
    return ep.select("conv_id", "turn", "content", F.col("context")["type"].alias("context_type"))


@query("json_results", f"""WITH {METRICS_SQL}
SELECT doc_id, CAST(to_json(struct_pack(file_path := d.source || '/' || CAST(doc_id AS VARCHAR),
    quality_score := CAST(quality_score AS DOUBLE), rating := rating, issues_found := issues_found,
    metrics := struct_pack(lines_of_code := lines_of_code, function_count := function_count,
                           class_count := class_count, complexity := complexity,
                           security_issues := security_issues))) AS VARCHAR) AS json
FROM metrics JOIN documents d USING (doc_id)""")
def q_json_results(m):
    """One JSON document per analysed file."""
    return rp.json_results(_metrics_with_path(m))


@query("analysis_bands", f"""WITH {METRICS_SQL}
SELECT doc_id, regexp_extract(p, '([^/\\\\]+)$', 1) AS file_name,
       regexp_extract(p, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) AS file_stem,
       CASE WHEN complexity < 5 THEN 'green' WHEN complexity < 8 THEN 'yellow' ELSE 'red' END AS complexity_band,
       CASE WHEN complexity >= 20 THEN 'critical' WHEN complexity >= 10 THEN 'warning' ELSE 'ok' END
         AS complexity_alert,
       array_to_string(list_transform(list_filter(string_split(recommendations, '; '), lambda r: r <> '')[1:3],
                                      lambda r, i: CAST(i AS VARCHAR) || '. ' || r), ' | ') AS top_recommendations
FROM (SELECT *, d.source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS p
      FROM metrics JOIN documents d USING (doc_id))""")
def q_analysis_bands(m):
    """P4, P7, P8, F8 on every analysed file."""
    from weft.functions import scalar as sc
    docs = m.raw("documents").withColumn("p", F.concat(
        F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    met = cp.code_metrics(docs, carry=("p",))
    recs = F.filter(F.split(F.col("recommendations"), "; "), lambda r: r != "")
    return met.select("doc_id", sc.file_name(F.col("p")).alias("file_name"),
                      sc.file_stem(F.col("p")).alias("file_stem"),
                      sc.complexity_band(F.col("complexity")).alias("complexity_band"),
                      sc.complexity_alert(F.col("complexity")).alias("complexity_alert"),
                      F.array_join(sc.top_numbered(recs, 3), " | ").alias("top_recommendations"))
