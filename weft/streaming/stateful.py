"""Keyed stateful processors for ``transformWithStateInPandas``.

Each processor keeps one key's state in the state store (RocksDB) and folds
that key's new rows in ``seq`` order every micro-batch, with numpy over the
whole batch: the agent processor composes clamp maps (load) and picks the last
effect, the heartbeat processor applies the gap rule as a running maximum,
and the admission processor runs the shared skipping state machine.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType)

from weft.operators.events import (LOAD_CAP_TENTHS, STATE_CHANGED, TASK_ASSIGNED, TASK_COMPLETED,
                                   TASK_FAILED)
from weft.operators.resources import OUTCOMES, admit_run
from weft.plans.ordered import compose_clamps_np


def _rows(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    if not parts:
        return pd.DataFrame()
    return pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable")


def effects(pdf: pd.DataFrame) -> np.ndarray:
    """The state each event puts its agent in; empty text for no change."""
    et, ns = pdf["event_type"].to_numpy(), pdf["new_state"].to_numpy()
    has_task = pdf["task_id"].notna().to_numpy()
    change = et == STATE_CHANGED
    return np.select(
        [(et == TASK_COMPLETED) & has_task, (et == TASK_FAILED) & has_task,
         change & (ns == "busy"), change & (ns == "idle"), change & (ns == "unresponsive")],
        ["idle", "error", "busy", "idle", "error"], default="")


AGENT_OUT = "agent_id long, state string, load_tenths long, last_seq long"


class AgentStateProcessor(StatefulProcessor):
    """Running state and clamped load per registered agent. The initial
    state (registry row) marks an agent as registered; events of agents
    without state are ignored, as the coordinator ignores unknown agents."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.st = handle.getValueState("agent", StructType([
            StructField("state", StringType()), StructField("tenths", LongType()),
            StructField("last_seq", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        r = initialState.iloc[0]
        self.st.update((str(r["state"]), int(round(float(r["load_factor"]) * 10)), -1))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty or not self.st.exists():
            return iter([])
        state, tenths, last = self.st.get()
        et, ns = pdf["event_type"].to_numpy(), pdf["new_state"].to_numpy()
        has_task = pdf["task_id"].notna().to_numpy()
        change = et == STATE_CHANGED
        effect = effects(pdf)
        hits = np.flatnonzero(effect != "")
        if len(hits):
            state = str(effect[hits[-1]])
        step = np.select([change & (ns == "busy"), (et == TASK_COMPLETED) & has_task], [1, -1], 0)
        steps = step[step != 0]
        D, L, H = compose_clamps_np(steps, np.zeros_like(steps),
                                    np.full_like(steps, LOAD_CAP_TENTHS))
        tenths = min(H, max(L, tenths + D))
        last = int(pdf["seq"].iloc[-1])
        self.st.update((state, tenths, last))
        return iter([pd.DataFrame({"agent_id": [key[0]], "state": [state],
                                   "load_tenths": [tenths], "last_seq": [last]})])

    def close(self) -> None:
        pass


RUNS = "seq long, last long, effect string, d long, low long, high long"


def fold_runs(batches):
    """mapInArrow body before T2's state: an agent's events of one Arrow batch as one
    row (its first and last ``seq``, its last effect, the composed clamp of its load)."""
    import pyarrow as pa
    for b in batches:
        pdf = b.to_pandas()
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["agent_id", "seq"], kind="stable")
        agent = pdf["agent_id"].to_numpy()
        effect = effects(pdf)
        et, ns = pdf["event_type"].to_numpy(), pdf["new_state"].to_numpy()
        step = np.select([(et == STATE_CHANGED) & (ns == "busy"), (et == TASK_COMPLETED) & pdf["task_id"].notna().to_numpy()], [1, -1], 0)
        null = pdf["agent_id"].isna().to_numpy()
        cut = np.flatnonzero(np.r_[True, (agent[1:] != agent[:-1]) & ~(null[1:] & null[:-1])])
        rows = []
        for x, y in zip(cut, np.r_[cut[1:], len(pdf)]):
            told = np.flatnonzero(effect[x:y] != "")
            s = step[x:y][step[x:y] != 0]
            d, low, high = compose_clamps_np(s, np.zeros_like(s), np.full_like(s, LOAD_CAP_TENTHS))
            rows.append((int(pdf["seq"].iloc[x]), int(pdf["seq"].iloc[y - 1]), str(effect[x + told[-1]]) if len(told) else None, d, low, high))
        order = pa.array(pdf.index.to_numpy()[cut])  # for the keys, of whatever type
        cols = [pa.array([r[i] for r in rows], pa.string() if i == 2 else pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays([b.column("agent_id").take(order), *cols], names=["agent_id", "seq", "last", "effect", "d", "low", "high"])


class AgentRunsProcessor(AgentStateProcessor):
    """T2 on the rows of :func:`fold_runs`, a few per agent and micro-batch whatever the
    number of events. Runs of one agent must not overlap, that is, events lie
    in their files in the order of ``seq``; an overlap raises an error."""

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty or not self.st.exists():
            return iter([])
        state, tenths, last = self.st.get()
        end = None
        for seq, until, effect, d, low, high in pdf[["seq", "last", "effect", "d", "low", "high"]].itertuples(index=False):
            if end is not None and seq <= end:
                raise ValueError(f"events of agent {key[0]} overlap: a run begins at {seq}, another ends at {end}")
            end = int(until)
            state = effect if isinstance(effect, str) else state
            tenths = int(min(high, max(low, tenths + d)))
        self.st.update((state, tenths, end))
        return iter([pd.DataFrame({"agent_id": [key[0]], "state": [state], "load_tenths": [tenths], "last_seq": [end]})])


HEARTBEAT_OUT = "agent_id long, last_seen_us long, kind string"


def gap_alerts(ts_us: np.ndarray, stored, alerted: bool, timeout_us: int, watched=None):
    """Gap rule over one key's new heartbeats (arrival order, microseconds).

    Each event is compared with the latest heartbeat before it (the running
    maximum, starting from the stored one); a gap over the timeout is an
    alert reporting that heartbeat. If the stored heartbeat's silence was
    already reported by a timer, the first event that reaches it is not
    reported again. ``watched`` marks the events before which the agent was
    being watched (all, if not given). Returns (alerted heartbeats, new last,
    new flag).
    """
    if stored is not None:
        prior = np.maximum.accumulate(np.r_[stored, ts_us])
    else:
        prior = np.r_[ts_us[0], np.maximum.accumulate(ts_us)]
    prev = prior[:-1]
    alert = ts_us - prev > timeout_us
    reached = np.flatnonzero(ts_us >= stored) if stored is not None else np.array([], dtype=int)
    if stored is not None and alerted and len(reached):
        alert[reached[0]] = False
    if watched is not None:
        alert &= watched
    last = int(prior[-1])
    flag = bool(alerted and stored is not None and not len(reached))
    return prev[alert].tolist(), last, flag


class HeartbeatProcessor(StatefulProcessor):
    """One alert per silence longer than the timeout.

    Any event of an agent is a heartbeat. A silence between two events that
    both arrived is found in ``handleInputRows`` (the gap rule: Spark runs
    input handling before expired timers in a batch, so the timer cannot be
    relied on for it). A silence still open is found by an event-time timer
    at ``last + timeout + 1 µs`` (strict ``>``). ``alerted`` keeps a return
    after a fired timer from alerting twice for the same silence.
    """

    def __init__(self, timeout_s: float = 90.0):
        self.timeout_us = int(round(timeout_s * 1_000_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.st = handle.getValueState("beat", StructType([
            StructField("last_us", LongType()), StructField("alerted", BooleanType())]))

    def _timer_ms(self, last_us: int) -> int:
        # fires once the watermark (ms) passes last + timeout
        return (last_us + self.timeout_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty:
            return iter([])
        ts_us = pdf["ts_us"].to_numpy(dtype=np.int64)
        stored, alerted = self.st.get() if self.st.exists() else (None, False)
        if stored is not None:
            self.handle.deleteTimer(self._timer_ms(stored))
        out, last, alerted = gap_alerts(ts_us, stored, alerted, self.timeout_us)
        self.st.update((last, alerted))
        self.handle.registerTimer(self._timer_ms(last))
        if not out:
            return iter([])
        return iter([pd.DataFrame({"agent_id": [key[0]] * len(out), "last_seen_us": out,
                                   "kind": ["gap"] * len(out)})])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        if not self.st.exists():
            return iter([])
        last, alerted = self.st.get()
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        if alerted or wm_us - last <= self.timeout_us:
            return iter([])
        self.st.update((last, True))
        return iter([pd.DataFrame({"agent_id": [key[0]], "last_seen_us": [last],
                                   "kind": ["open"]})])

    def close(self) -> None:
        pass


class RegisteredHeartbeatProcessor(HeartbeatProcessor):
    """T3 as the monitor applies it, on the events of registered agents (each
    row carries the registry's ``reg_state``): no alert while an agent's
    state, folded from its events, is error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.reg = handle.getValueState("registered", StructType([StructField("state", StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty:
            return iter([])
        state = self.reg.get()[0] if self.reg.exists() else str(pdf["reg_state"].iloc[0])
        # the state before each event, and after the last one
        known = np.concatenate(([state], effects(pdf))).astype(object)
        at = np.maximum.accumulate(np.where(known != "", np.arange(len(known)), 0))
        folded = known[at]
        stored, alerted = self.st.get() if self.st.exists() else (None, False)
        if stored is not None:
            self.handle.deleteTimer(self._timer_ms(stored))
        out, last, alerted = gap_alerts(pdf["ts_us"].to_numpy(dtype=np.int64), stored, alerted,
                                        self.timeout_us, folded[:-1] != "error")
        self.st.update((last, alerted))
        self.reg.update((str(folded[-1]),))
        self.handle.registerTimer(self._timer_ms(last))
        if not out:
            return iter([])
        return iter([pd.DataFrame({"agent_id": [key[0]] * len(out), "last_seen_us": out,
                                   "kind": ["gap"] * len(out)})])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        if not self.reg.exists() or self.reg.get()[0] == "error":
            return iter([])
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


REGISTERED = "registered"
COORDINATION_OUT = ("agent_id long, kind string, state string, load_tenths long, last_seq long, last_seen_us long")


class CoordinationProcessor(StatefulProcessor):
    """S11, T2 and T3 as one machine per agent, over the event log alone.

    A ``registered`` event makes the agent known: idle, without load, heard of
    at that time; a later one starts it afresh. Other events count only after
    that, by ``seq``, whenever they arrive. A silence longer than the timeout
    puts a known agent in error and is reported once, unless it was in error
    before. Silences that an event ends are found among the rows; those still
    open by an event-time timer, which is armed at registration already, so an
    agent that never sends anything is reported too. After a timer the state is
    error, so its end is not reported again.

    One row per micro-batch and agent with its state (kind ``state``) and one
    per reported silence (kind ``silence``, with the last time it was heard)."""

    def __init__(self, timeout_s: float = 90.0):
        self.timeout_us = int(round(timeout_s * 1_000_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.st = handle.getValueState("agent", StructType([
            StructField("state", StringType()), StructField("tenths", LongType()), StructField("last_us", LongType()),
            StructField("last_seq", LongType()), StructField("since", LongType())]))

    def _timer_ms(self, last_us: int) -> int:
        return (last_us + self.timeout_us) // 1000 + 1

    @staticmethod
    def _out(key, state, tenths, last_seq, heard, silences) -> pd.DataFrame:
        n = len(silences)
        return pd.DataFrame({
            "agent_id": [key[0]] * (n + 1), "kind": ["silence"] * n + ["state"], "state": [None] * n + [state],
            "load_tenths": pd.array([None] * n + [tenths], dtype="Int64"), "last_seq": pd.array([None] * n + [last_seq], dtype="Int64"),
            "last_seen_us": pd.array([*silences, heard], dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty:
            return iter([])
        known = self.st.exists()
        state, tenths, last, last_seq, since = self.st.get() if known else (None, 0, None, None, None)
        joined = ((pdf["event_type"] == STATE_CHANGED) & (pdf["new_state"] == REGISTERED)).to_numpy()
        if not known:
            first = np.flatnonzero(joined)
            if not len(first):
                return iter([])
            since = int(pdf["seq"].iloc[first[0]])
        keep = (pdf["seq"] >= since).to_numpy()
        pdf, joined = pdf[keep], joined[keep]
        if pdf.empty:
            return iter([])
        if last is not None:
            self.handle.deleteTimer(self._timer_ms(last))
        ts = pdf["ts_us"].to_numpy(dtype=np.int64)
        heard = np.maximum.accumulate(np.r_[ts[0] if last is None else last, ts])
        silent = ts - heard[:-1] > self.timeout_us
        effect = np.where(joined, "idle", effects(pdf))
        # what each event leaves behind: its effect, or the error of the silence it ends
        after = np.where(effect != "", effect, np.where(silent, "error", ""))
        told = np.concatenate(([state or "idle"], after)).astype(object)
        at = np.maximum.accumulate(np.where(told != "", np.arange(len(told)), 0))
        folded = told[at]
        silences = heard[:-1][silent & (folded[:-1] != "error")].tolist()
        et, ns = pdf["event_type"].to_numpy(), pdf["new_state"].to_numpy()
        step = np.select([(et == STATE_CHANGED) & (ns == "busy"), (et == TASK_COMPLETED) & pdf["task_id"].notna().to_numpy()], [1, -1], 0)
        if joined.any():  # load starts again with the last registration
            begin = int(np.flatnonzero(joined)[-1])
            step, tenths = step[begin:], 0
        steps = step[step != 0]
        d, low, high = compose_clamps_np(steps, np.zeros_like(steps), np.full_like(steps, LOAD_CAP_TENTHS))
        tenths = min(high, max(low, tenths + d))
        state, last, last_seq = str(folded[-1]), int(heard[-1]), max(int(pdf["seq"].max()), last_seq or 0)
        self.st.update((state, tenths, last, last_seq, since))
        self.handle.registerTimer(self._timer_ms(last))
        return iter([self._out(key, state, tenths, last_seq, last, silences)])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        if not self.st.exists():
            return iter([])
        state, tenths, last, last_seq, since = self.st.get()
        if state == "error" or timerValues.getCurrentWatermarkInMs() * 1000 - last <= self.timeout_us:
            return iter([])
        self.st.update(("error", tenths, last, last_seq, since))
        return iter([self._out(key, "error", tenths, last_seq, last, [last])])

    def close(self) -> None:
        pass


ADMISSION_OUT = ("seq long, resource_id long, agent_id long, action string, outcome string, "
                 "holders_after int")


class ResourceAdmissionProcessor(StatefulProcessor):
    """T4: per-resource admission. Limit from the initial state (the
    registry); holders kept as a list in state. Unregistered resources deny
    requests and ignore releases."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.st = handle.getValueState("res", StructType([
            StructField("limit", IntegerType()),
            StructField("holders", ArrayType(LongType()))]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.st.update((int(initialState.iloc[0]["max_concurrent"]), []))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        if pdf.empty:
            return iter([])
        registered = self.st.exists()
        limit, holders = self.st.get() if registered else (None, [])
        code, after, holders = admit_run(pdf["agent_id"].to_numpy(),
                                         (pdf["action"] == "request").to_numpy(),
                                         limit if registered else None, list(holders or []))
        if registered:
            self.st.update((limit, [int(h) for h in holders]))
        return iter([pd.DataFrame({
            "seq": pdf["seq"].astype("int64").values, "resource_id": [key[0]] * len(pdf),
            "agent_id": pdf["agent_id"].astype("int64").values, "action": pdf["action"].values,
            "outcome": OUTCOMES[code], "holders_after": after})])

    def close(self) -> None:
        pass


LIFECYCLE_OUT = "task_id long, status string, seq long, started_us long"


#: An active task in the state: whether it runs, and since when if that was seen.
ACTIVE = np.dtype([("task_id", "<i8"), ("running", "?"), ("seen", "?"), ("started_us", "<i8")])


class TaskLifecycleProcessor(StatefulProcessor):
    """T5: pending tasks run from their first assignment (``started_us`` is its
    time), running tasks close with their first terminal event. A key is a
    bucket of tasks, so a call folds the events of thousands of tasks at once; its
    state holds the bucket's active tasks by id. The initial
    state holds only the pending and running tasks — no event changes a closed
    or unknown task — and a task leaves the state once it closes, so
    the store holds the active set, not the whole task history. Later or
    duplicate events find no state and are ignored, as the reference does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.st = handle.getValueState("tasks", StructType([StructField("active", BinaryType())]))

    def _active(self) -> np.ndarray:
        return np.frombuffer(self.st.get()[0], ACTIVE) if self.st.exists() else np.zeros(0, ACTIVE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        new = np.zeros(len(initialState), ACTIVE)  # a large bucket comes in several parts
        new["task_id"], new["running"] = initialState["task_id"].to_numpy(), (initialState["status"] == "running").to_numpy()
        active = np.concatenate([self._active(), new])
        _, first = np.unique(active["task_id"], return_index=True)
        self.st.update((active[first].tobytes(),))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _rows(rows)
        active = self._active().copy()
        if pdf.empty or not len(active):
            return iter([])
        task = pdf["task_id"].to_numpy()
        at = np.minimum(np.searchsorted(active["task_id"], task), len(active) - 1)
        known = active["task_id"][at] == task
        pdf, at = pdf[known], at[known]
        et, seq, pos, none = pdf["event_type"].to_numpy(), pdf["seq"].to_numpy(), np.arange(len(pdf)), len(pdf)

        def first(which: np.ndarray) -> np.ndarray:
            """The first of these events of each task, ``none`` without one."""
            out = np.full(len(active), none)
            np.minimum.at(out, at[which], pos[which])
            return out

        given = np.where(active["running"], -1, first(et == TASK_ASSIGNED))
        ended = first(((et == TASK_COMPLETED) | (et == TASK_FAILED)) & (pos > given[at]))
        begun, closed = np.flatnonzero((given >= 0) & (given < none)), np.flatnonzero(ended < none)
        if not len(begun) and not len(closed):
            return iter([])
        ts = pdf["ts_us"].iloc[given[begun]]
        active["running"][begun], active["seen"][begun] = True, ts.notna().to_numpy()
        active["started_us"][begun] = ts.fillna(0).to_numpy().astype(np.int64)
        left = np.delete(active, closed)
        if len(left):
            self.st.update((left.tobytes(),))
        else:
            self.st.clear()
        who = np.concatenate([begun, closed])
        how = np.where(et[ended[closed]] == TASK_COMPLETED, "completed", "failed")
        return iter([pd.DataFrame({
            "task_id": active["task_id"][who], "status": ["running"] * len(begun) + how.tolist(), "seq": seq[np.concatenate([given[begun], ended[closed]])],
            "started_us": pd.Series(active["started_us"][who]).astype("Int64").where(active["seen"][who])})])

    def close(self) -> None:
        pass
