"""Small hand-written model tables, one case per quirk (our own rows)."""

import datetime as dt

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


EVENT_SCHEMA = ("seq long, event_id long, event_type string, source_agent string, "
                "target_agent string, priority int, ts timestamp, new_state string, "
                "task_id string, execution_time double, error string")


def event(seq, et, src, new_state=None, task_id=None, t=None, execution_time=None, error=None):
    return (seq, seq, et, src, None, 2, ts(t if t is not None else seq), new_state, task_id,
            execution_time, error)


AGENT_SCHEMA = ("reg_seq long, agent_id string, agent_type string, capabilities array<string>, "
                "state string, load_factor double")

TASK_SCHEMA = ("seq long, task_id string, task_type string, agent_id string, priority int, "
               "dependencies array<string>, status string, created_at timestamp")


def task(seq, tid, ttype, priority, deps, status):
    return (seq, tid, ttype, None, priority, deps, status, ts(seq))
