"""Catalog entries: event payloads with any keys."""

import uuid

from pyspark.sql import functions as F

from weft.functions.payload import field
from weft.operators import events as ev
from weft.operators import reports as rp
from weft.plans.catalog import query
from weft.session import scratch_path
from weft.sources.adapters import PAYLOAD_SQL, payload_events

RAW_TYPE_SQL = """CASE event_type WHEN 'click' THEN 'agent_state_changed' WHEN 'view' THEN 'agent_state_changed'
  WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_failed' WHEN 'signup' THEN 'task_assigned' END"""


@query("payload_log_lines", f"""
SELECT event_id AS seq, 'Event: ' || {RAW_TYPE_SQL} || ' from ' || user_id || ' to '
  || CASE WHEN event_type = 'signup' THEN CAST(user_id % 100 + 1 AS VARCHAR) ELSE 'all' END || ' - {{''kind'': ''' || event_type
  || ''', ''value'': ' || CAST(value AS VARCHAR) || ', ''props'': {{''k'': ' || json_extract_string(props, '$.k')
  || '}}, ''tags'': ["it''s", ''say "hi"'', None, True, {{''deep'': [' || user_id || ', 2], ''a:b'': ''x, y''}}]'
  || CASE WHEN event_type = 'error' THEN ', ''error'': ''code' || chr(92) || 'n' || event_id % 7 || '''' ELSE '' END || '}}' AS line
FROM events""")
def q_payload_log_lines(m):
    """Payloads with nested, unknown and odd keys, printed whole."""
    return ev.payload_log_lines(payload_events(m.raw("events")))


@query("payload_fields", f"""
SELECT event_id AS seq, CAST(json_extract(p, '$.props.k') AS BIGINT) AS k, json_extract_string(p, '$.tags[4].deep[1]') AS deep,
       coalesce(json_extract_string(p, '$.error'), 'Unknown error') AS error, coalesce(json_extract_string(p, '$.nowhere.at.all'), 'N/A') AS missing,
       coalesce(TRY_CAST(json_extract_string(p, '$.kind') AS BIGINT), -1) AS wrong_kind, CAST(json_array_length(p, '$.tags') AS BIGINT) AS n_tags
FROM (SELECT event_id, {PAYLOAD_SQL} AS p FROM events)""")
def q_payload_fields(m):
    """Values by path, with defaults for missing keys and other kinds."""
    p = F.col("payload")
    return payload_events(m.raw("events")).select(
        "seq", field(p, "$.props.k", "bigint").alias("k"), field(p, "$.tags[4].deep[1]", "string").alias("deep"),
        field(p, "$.error", "string", "Unknown error").alias("error"), field(p, "$.nowhere.at.all", "string", "N/A").alias("missing"),
        field(p, "$.kind", "bigint", F.lit(-1).cast("bigint")).alias("wrong_kind"),
        F.size(F.try_variant_get(p, "$.tags", "array<variant>")).cast("bigint").alias("n_tags"))


@query("payload_json", f"""
SELECT event_id AS seq, '{{' || CASE WHEN event_type = 'error' THEN '"error":' || CAST(json_extract(p, '$.error') AS VARCHAR) || ',' ELSE '' END
  || '"kind":"' || event_type || '","props":{{"k":' || json_extract_string(p, '$.props.k') || '}},"tags":["it''s","say ' || chr(92) || '"hi' || chr(92) || '"",null,true,'
  || '{{"a:b":"x, y","deep":[' || user_id || ',2]}}]}}' AS json
FROM (SELECT *, {PAYLOAD_SQL} AS p FROM events)""")
def q_payload_json(m):
    """Payloads written as JSON and read back whole (without the one number
    that engines print differently); a VARIANT keeps its keys by name."""
    e = payload_events(m.raw("events"))
    kept = F.parse_json(F.regexp_replace("payload_json", '"value": [^,]*, ', ""))
    folder = scratch_path(m.spark, f"io/payload-{uuid.uuid4().hex[:12]}")
    rp.write_json(e.select("seq", kept.alias("payload")), folder)
    back = m.spark.read.schema("seq long, payload variant").json(folder)
    return back.select("seq", F.to_json("payload").alias("json"))
