"""Model tables derived from the driver's testdata tables.

The testdata holds no tasks, agents or resources, so each model table is a
projection of a testdata table. Every Spark adapter has a DuckDB twin in
:data:`SQL_CTES`; the two must stay expression-for-expression equal because
the oracle check compares their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import load

# Fixed values of the testdata mapping (see FIXTURES.md).
RAW_EVENT_TYPE = {
    "click": "agent_state_changed",
    "view": "agent_state_changed",
    "purchase": "task_completed",
    "error": "task_failed",
    "signup": "task_assigned",
}
RAW_NEW_STATE = {"click": "busy", "view": "idle"}
TASK_EVENT_RAW = ("purchase", "error", "signup")
ORDER_PRIORITY = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 2, "5-LOW": 1}
N_TASK_TYPES = 7
N_CAPABILITIES = 6
N_RESOURCE_KEYS = 30          # requested ids; nations register 0-24, the rest are unknown
UNREQUESTED = 24              # registered but never requested


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out


def model_events(raw: DataFrame) -> DataFrame:
    """events(seq, event_id, event_type, source_agent, target_agent, priority,
    ts, new_state, task_id, execution_time, error)."""
    et = F.col("event_type")
    return raw.select(
        F.col("event_id").alias("seq"),
        F.col("event_id"),
        _case(et, RAW_EVENT_TYPE).alias("event_type"),
        F.col("user_id").alias("source_agent"),
        F.when(et == "signup", F.col("user_id") % 100 + 1).alias("target_agent"),
        (1 + F.col("event_id") % 4).cast("int").alias("priority"),
        F.col("ts"),
        _case(et, RAW_NEW_STATE).alias("new_state"),
        F.when(et.isin(*TASK_EVENT_RAW), F.col("event_id")).alias("task_id"),
        F.when(et == "purchase", F.col("value")).alias("execution_time"),
        F.when((et == "error") & (F.col("event_id") % 3 != 0),
               F.concat(F.lit("code "), (F.col("event_id") % 7).cast("string"))).alias("error"),
    )


#: A raw event's payload as JSON text, one SQL expression for both engines.
PAYLOAD_SQL = """'{"kind": "' || event_type || '", "value": ' || CAST(value AS STRING) || ', "props": ' || props
  || ', "tags": ["it' || chr(39) || 's", "say ' || chr(92) || '"hi' || chr(92) || '"", null, true, {"deep": [' || CAST(user_id AS STRING) || ', 2], "a:b": "x, y"}]'
  || CASE WHEN event_type = 'error' THEN ', "error": "code' || chr(92) || 'n' || CAST(event_id % 7 AS STRING) || '"' ELSE '' END || '}'"""


def payload_events(raw: DataFrame) -> DataFrame:
    """events(seq, event_type, source_agent, target_agent, ts, payload_json, payload VARIANT)."""
    return raw.select(
        F.col("event_id").alias("seq"), _case(F.col("event_type"), RAW_EVENT_TYPE).alias("event_type"), F.col("user_id").alias("source_agent"),
        F.when(F.col("event_type") == "signup", F.col("user_id") % 100 + 1).alias("target_agent"), "ts",
        F.expr(PAYLOAD_SQL).alias("payload_json")).withColumn("payload", F.try_parse_json("payload_json"))


SILENT_FROM = 1_000_000       # ids of agents that register and send nothing


def coordination_events(raw: DataFrame) -> DataFrame:
    """The event log with registrations in it: a sign-up registers its user as an
    agent, every fifth one an agent of its own that never sends anything."""
    up = F.col("event_type") == "signup"
    quiet = up & (F.col("event_id") % 5 == 0)
    return raw.select(
        F.col("event_id").alias("seq"),
        F.when(up, "agent_state_changed").otherwise(_case(F.col("event_type"), RAW_EVENT_TYPE)).alias("event_type"),
        F.when(quiet, F.col("event_id") + SILENT_FROM).otherwise(F.col("user_id")).alias("source_agent"),
        "ts",
        F.when(up, "registered").otherwise(_case(F.col("event_type"), RAW_NEW_STATE)).alias("new_state"),
        F.when(~up & F.col("event_type").isin(*TASK_EVENT_RAW), F.col("event_id")).alias("task_id"))


def model_tasks(orders: DataFrame) -> DataFrame:
    """tasks(seq, task_id, task_type, agent_id, priority, dependencies,
    status, created_at) from orders."""
    k = F.col("o_orderkey")
    deps = (F.when(k % 3 == 0, F.array().cast("array<bigint>"))
            .when(k % 3 == 1, F.array(k - 1))
            .otherwise(F.array(k - 1, k - 7)))
    status = (F.when(F.col("o_orderstatus") == "O", "pending")
              .when(F.col("o_orderstatus") == "P", "running")
              .when(k % 10 == 0, "failed")
              .otherwise("completed"))
    return orders.select(
        k.alias("seq"),
        k.alias("task_id"),
        (F.col("o_custkey") % N_TASK_TYPES).alias("task_type"),
        F.lit(None).cast("bigint").alias("agent_id"),
        _case(F.col("o_orderpriority"), ORDER_PRIORITY).alias("priority"),
        deps.alias("dependencies"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def model_agents(supplier: DataFrame) -> DataFrame:
    """agents(reg_seq, agent_id, agent_type, capabilities, state, load_factor)."""
    s = F.col("s_suppkey")
    caps = F.array_sort(F.array_distinct(F.array(
        (F.col("s_nationkey") % N_CAPABILITIES).cast("bigint"), s % N_CAPABILITIES)))
    state = F.when(s % 5 == 0, "error").when(s % 5 == 1, "busy").otherwise("idle")
    return supplier.select(
        s.alias("reg_seq"),
        s.alias("agent_id"),
        F.lit("worker").alias("agent_type"),
        caps.alias("capabilities"),
        state.alias("state"),
        ((s % 11).cast("double") / 10).alias("load_factor"),
    )


def model_agent_metrics(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("agent_id"),
                      F.col("event_type").alias("metric"), "ts", "value")


def model_system_metrics(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_id").alias("seq"), F.col("event_type").alias("metric"),
                      "ts", "value")


def model_resource_log(raw: DataFrame) -> DataFrame:
    """resource_log(seq, resource_id, agent_id, action): purchase requests,
    view releases."""
    return (raw.where(F.col("event_type").isin("purchase", "view"))
            .select(F.col("event_id").alias("seq"),
                    F.when(F.col("user_id") % N_RESOURCE_KEYS == UNREQUESTED, F.lit(29).cast("bigint"))
                    .otherwise(F.col("user_id") % N_RESOURCE_KEYS).alias("resource_id"),
                    F.col("user_id").alias("agent_id"),
                    F.when(F.col("event_type") == "purchase", "request")
                    .otherwise("release").alias("action")))


def model_resources(nation: DataFrame) -> DataFrame:
    """resources(resource_id, max_concurrent): one per nation."""
    return nation.select(F.col("n_nationkey").cast("bigint").alias("resource_id"),
                         (1 + F.col("n_nationkey") % 3).alias("max_concurrent"))


class Model:
    """Lazily built model tables for one testdata directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def events(self) -> DataFrame:
        return model_events(self.raw("events"))

    def tasks(self) -> DataFrame:
        return model_tasks(self.raw("orders"))

    def agents(self) -> DataFrame:
        return model_agents(self.raw("supplier"))

    def agent_metrics(self) -> DataFrame:
        return model_agent_metrics(self.raw("events"))

    def system_metrics(self) -> DataFrame:
        return model_system_metrics(self.raw("events"))

    def resource_log(self) -> DataFrame:
        return model_resource_log(self.raw("events"))

    def resources(self) -> DataFrame:
        return model_resources(self.raw("nation"))


# DuckDB twins of the adapters, used as CTEs by the oracle SQL.
SQL_CTES = {
    "ev": """ev AS (
  SELECT event_id AS seq, event_id,
         CASE event_type WHEN 'click' THEN 'agent_state_changed'
                         WHEN 'view' THEN 'agent_state_changed'
                         WHEN 'purchase' THEN 'task_completed'
                         WHEN 'error' THEN 'task_failed'
                         WHEN 'signup' THEN 'task_assigned' END AS event_type,
         user_id AS source_agent, CASE WHEN event_type = 'signup' THEN user_id % 100 + 1 END AS target_agent,
         CAST(1 + event_id % 4 AS INTEGER) AS priority, ts,
         CASE event_type WHEN 'click' THEN 'busy' WHEN 'view' THEN 'idle' END AS new_state,
         CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN event_id END AS task_id,
         CASE WHEN event_type = 'purchase' THEN value END AS execution_time,
         CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'code ' || CAST(event_id % 7 AS VARCHAR) END AS error
  FROM events)""",
    "cev": """cev AS (
  SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'agent_state_changed' WHEN 'view' THEN 'agent_state_changed'
           WHEN 'signup' THEN 'agent_state_changed' WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_failed' END AS event_type,
         CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN event_id + 1000000 ELSE user_id END AS source_agent, ts,
         CASE event_type WHEN 'click' THEN 'busy' WHEN 'view' THEN 'idle' WHEN 'signup' THEN 'registered' END AS new_state,
         CASE WHEN event_type IN ('purchase', 'error') THEN event_id END AS task_id
  FROM events)""",
    "tk": """tk AS (
  SELECT o_orderkey AS seq, o_orderkey AS task_id, o_custkey % 7 AS task_type,
         CAST(NULL AS BIGINT) AS agent_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3
              WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 END AS priority,
         CASE o_orderkey % 3 WHEN 0 THEN CAST([] AS BIGINT[])
              WHEN 1 THEN [o_orderkey - 1] ELSE [o_orderkey - 1, o_orderkey - 7] END AS dependencies,
         CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running'
              WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
         o_orderdate AS created_at
  FROM orders)""",
    "ag": """ag AS (
  SELECT s_suppkey AS reg_seq, s_suppkey AS agent_id, 'worker' AS agent_type,
         list_sort(list_distinct([CAST(s_nationkey % 6 AS BIGINT), s_suppkey % 6])) AS capabilities,
         CASE s_suppkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'busy' ELSE 'idle' END AS state,
         CAST(s_suppkey % 11 AS DOUBLE) / 10 AS load_factor
  FROM supplier)""",
    "am": """am AS (SELECT event_id AS seq, user_id AS agent_id, event_type AS metric, ts, value FROM events)""",
    "sm": """sm AS (SELECT event_id AS seq, event_type AS metric, ts, value FROM events)""",
    "rl": """rl AS (
  SELECT event_id AS seq, CASE WHEN user_id % 30 = 24 THEN 29 ELSE user_id % 30 END AS resource_id, user_id AS agent_id,
         CASE WHEN event_type = 'purchase' THEN 'request' ELSE 'release' END AS action
  FROM events WHERE event_type IN ('purchase', 'view'))""",
    "rs": """rs AS (SELECT CAST(n_nationkey AS BIGINT) AS resource_id, 1 + n_nationkey % 3 AS max_concurrent
  FROM nation)""",
}


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the named adapter CTEs and any extra CTE texts."""
    parts = [SQL_CTES[n] for n in names] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
