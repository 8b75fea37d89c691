"""Operators over the coordination event log.

Input is the model ``events`` table (see ``weft.sources.adapters``). Order is
always arrival order, the ``seq`` column, never the timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.payload import python_text
from weft.plans.ordered import DEFAULT_BITS, apply_clamp, clamp_fold, levels_for

# Fixed values of the event model.
TASK_COMPLETED = "task_completed"
TASK_FAILED = "task_failed"
TASK_ASSIGNED = "task_assigned"
STATE_CHANGED = "agent_state_changed"
EMERGENCY_STOP = "emergency_stop"
DEFAULT_ERROR = "Unknown error"
LOAD_CAP_TENTHS = 10


def event_counts(events: DataFrame) -> DataFrame:
    """A1: ``event_<type>`` counts plus a ``total_events`` row.

    The total is summed from the grouped result (one row per type), and the
    two branches share one exchange (Spark reuses it), so the log is
    scanned once; an empty log still reports ``total_events = 0``.
    """
    grouped = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    per_type = grouped.select(F.concat(F.lit("event_"), F.col("event_type")).alias("metric"), "n")
    total = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")) \
        .select(F.lit("total_events").alias("metric"), "n")
    return per_type.unionByName(total)


def agent_failures(events: DataFrame) -> DataFrame:
    """Failures per source agent; only failures that carry a task id count."""
    return (events.where((F.col("event_type") == TASK_FAILED) & F.col("task_id").isNotNull())
            .groupBy("source_agent").agg(F.count(F.lit(1)).alias("failures")))


def agent_completions(events: DataFrame) -> DataFrame:
    """Finished tasks per agent. ``tasks_completed`` counts failures too,
    as the simple coordinator does; the split is kept alongside."""
    fin = events.where(F.col("event_type").isin(TASK_COMPLETED, TASK_FAILED)
                       & F.col("task_id").isNotNull())
    return fin.groupBy(F.col("source_agent").alias("agent_id")).agg(
        F.count(F.lit(1)).alias("tasks_completed"),
        F.count_if(F.col("event_type") == TASK_COMPLETED).alias("tasks_succeeded"),
        F.count_if(F.col("event_type") == TASK_FAILED).alias("tasks_failed"))


def registered_events(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Events whose source agent is registered (left semi join; Spark
    broadcasts the registry when its measured size is under the threshold)."""
    return events.join(agents.select(F.col("agent_id").alias("source_agent")),
                       "source_agent", "left_semi")


def event_subset(events: DataFrame, event_type: str) -> DataFrame:
    """The events one handler type receives."""
    return events.where(F.col("event_type") == event_type)


def recent_events(events: DataFrame, n: int = 10) -> DataFrame:
    """K1: the last ``n`` events by arrival, oldest first (TakeOrderedAndProject
    keeps ``n`` rows; only those are sorted again)."""
    return (events.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")
            .select("seq", "ts", F.col("event_type").alias("type"),
                    F.col("source_agent").alias("source"), F.col("target_agent").alias("target")))


def event_history(events: DataFrame, n: int = 1000) -> DataFrame:
    """W2 (global form): the bounded history of the last ``n`` events."""
    return events.orderBy(F.col("seq").desc()).limit(n)


def agent_effect(events: DataFrame) -> Column:
    """State an event sets on its source agent, or null for none.

    completion with a task id -> idle; failure with a task id -> error;
    state change busy/idle as is, ``unresponsive`` -> error; anything else
    (``registered``, ``error`` or other values, other types) -> no effect.
    """
    et, ns, has_task = F.col("event_type"), F.col("new_state"), F.col("task_id").isNotNull()
    return (F.when((et == TASK_COMPLETED) & has_task, F.lit("idle"))
            .when((et == TASK_FAILED) & has_task, F.lit("error"))
            .when((et == STATE_CHANGED) & (ns == "busy"), F.lit("busy"))
            .when((et == STATE_CHANGED) & (ns == "idle"), F.lit("idle"))
            .when((et == STATE_CHANGED) & (ns == "unresponsive"), F.lit("error")))


# Agent states as small integer codes, so the last-effect
# aggregate has a fixed-width buffer (hash aggregate, not sort aggregate).
STATE_CODES = ["idle", "busy", "error"]


def agent_state(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Final state per registered agent = last effect by ``seq``, else the
    registered state. ``max_by`` over an integer code is a partial hash
    aggregate, so a hot agent is reduced map-side before the shuffle."""
    eff = agent_effect(events)
    code = None
    for i, name in enumerate(STATE_CODES):
        code = F.when(eff == name, F.lit(i)) if code is None else code.when(eff == name, F.lit(i))
    last = (registered_events(events, agents)
            .select(F.col("source_agent").alias("agent_id"), "seq", code.alias("code"))
            .where(F.col("code").isNotNull())
            .groupBy("agent_id")
            .agg(F.max_by("code", "seq").alias("code"), F.max("seq").alias("changed_at_seq")))
    names = F.array(*[F.lit(n) for n in STATE_CODES])
    return (agents.join(last, "agent_id", "left")
            .select("agent_id", F.coalesce(F.element_at(names, F.col("code") + 1), F.col("state"))
                    .alias("state"), "changed_at_seq"))


def load_steps(events: DataFrame) -> DataFrame:
    """Load changes in tenths: +1 on a ``busy`` event, -1 on a completion
    with a task id; each clamped to [0, 10]."""
    d = (F.when((F.col("event_type") == STATE_CHANGED) & (F.col("new_state") == "busy"), F.lit(1))
         .when((F.col("event_type") == TASK_COMPLETED) & F.col("task_id").isNotNull(), F.lit(-1)))
    return (events.select(F.col("source_agent").alias("agent_id"), "seq", d.alias("d"))
            .where(F.col("d").isNotNull())
            .withColumn("lo", F.lit(0)).withColumn("hi", F.lit(LOAD_CAP_TENTHS)))


def agent_load(events: DataFrame, agents: DataFrame) -> DataFrame:
    """Clamped running load per registered agent, in tenths and as a
    fraction. The fold is a tree of clamp-map compositions (see
    :func:`weft.plans.ordered.clamp_fold`), never a per-agent list."""
    steps = load_steps(registered_events(events, agents))
    shifts = [DEFAULT_BITS * (i + 1) for i in range(levels_for(events, "seq"))]
    folded = clamp_fold(steps, ["agent_id"], "seq", "d", "lo", "hi", shifts)
    start = F.round(F.col("load_factor") * 10).cast("bigint")
    tenths = apply_clamp(start, F.col("D"), F.col("L"), F.col("H"))
    return (agents.select("agent_id", "load_factor").join(folded, "agent_id", "left")
            .select("agent_id", tenths.alias("load_tenths"),
                    (tenths.cast("double") / 10).alias("load_factor")))


def fan_out_control(agents: DataFrame, reason: str = "Emergency stop requested") -> DataFrame:
    """One ``emergency_stop`` event per registered agent, each with its
    own id (the reference re-queues one mutated object; fixed here)."""
    return agents.select(
        F.concat(F.lit("stop-"), F.col("agent_id").cast("string")).alias("event_id"),
        F.lit(EMERGENCY_STOP).alias("event_type"),
        F.lit("coordinator").alias("source_agent"),
        F.col("agent_id").alias("target_agent"),
        F.lit(reason).alias("reason"))


def payload_text(events: DataFrame) -> Column:
    """Known payload keys of an event rendered like a Python dict
    (``{'task_id': 7, 'execution_time': 58.37}``); null keys are left out."""
    def kv(key: str, val: Column, quote: bool) -> Column:
        v = F.concat(F.lit("'"), val, F.lit("'")) if quote else val.cast("string")
        return F.when(val.isNotNull(), F.concat(F.lit(f"'{key}': "), v))
    parts = [kv("new_state", F.col("new_state"), True),
             kv("task_id", F.col("task_id"), False),
             kv("execution_time", F.col("execution_time"), False),
             kv("error", F.col("error"), True)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def payload_log_lines(events: DataFrame, payload: str = "payload_json") -> DataFrame:
    """S7 with any payload: every key of the JSON text, nested ones too; a missing
    payload prints as an empty one, text that isn't JSON as it is."""
    text = F.coalesce(F.col(payload), F.lit("{}"))
    shown = F.when(F.try_parse_json(text).isNotNull(), python_text(text)).otherwise(text)
    line = F.format_string("Event: %s from %s to %s - %s", F.col("event_type"), F.col("source_agent").cast("string"),
                           F.coalesce(F.col("target_agent").cast("string"), F.lit("all")), shown)
    return events.select("seq", line.alias("line"))


def event_log_lines(events: DataFrame) -> DataFrame:
    """One log line per event; a null target prints as ``all``."""
    line = F.format_string("Event: %s from %s to %s - %s", F.col("event_type"),
                           F.col("source_agent").cast("string"),
                           F.coalesce(F.col("target_agent").cast("string"), F.lit("all")),
                           payload_text(events))
    return events.select("seq", line.alias("line"))
