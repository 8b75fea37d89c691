"""Shared-resource admission and utilization.

``resource_log(seq, resource_id, agent_id, action)`` with action
``request`` / ``release``; ``resources(resource_id, max_concurrent)``.

Admission is a per-resource state machine over arrival order: a request is
granted while fewer than ``max_concurrent`` agents hold the resource; a
release removes one holding of that agent and is ignored for a non-holder;
an unregistered resource denies every request. Decisions depend on the whole
prefix of the resource's log, so the fold is not associative: each
resource's log is hash-partitioned to one task, sorted by ``seq`` (Spark's
external sort spills), and streamed through the state machine in Arrow
batches, holding only the current holders in memory. Different resources
run in parallel. A resource with more than ``HOT`` events is cut into chunks that
run at the same time (:mod:`weft.operators.admission_chunks`).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRANTED, DENIED, RELEASED, IGNORED = "granted", "denied", "released", "ignored"

OUT_SCHEMA = ("seq long, resource_id long, agent_id long, action string, "
              "outcome string, holders_after int")


OUTCOMES = np.array([GRANTED, DENIED, RELEASED, IGNORED], dtype=object)
_G, _D, _R, _I = 0, 1, 2, 3


HOT = 1 << 19     # events from which a resource's log is cut
SKIP_AFTER = 64   # unchanged events in a row before searching for the next change


def admit_run(agents: np.ndarray, is_request: np.ndarray, limit, holders: list
              ) -> tuple[np.ndarray, np.ndarray, list]:
    """Exact admission over one resource's events in order.

    Returns outcome codes, holder counts after each event and the holders
    left. Only two kinds of event change anything: a request while the
    resource is not full (granted) and a release by a current holder
    (released); requests while full are denied and releases by non-holders
    ignored. Events are stepped through one by one, but after SKIP_AFTER
    unchanged events in a row the next changing event is found by binary
    search (request positions, and the release positions of the at most
    ``limit`` holders) and the span before it is settled in one vectorised
    fill, so long saturated stretches cost O(limit log n) instead of one
    step per event, while busy stretches keep the plain loop's speed.
    ``limit=None`` means unregistered: every request is denied and every
    release ignored.
    """
    n = len(agents)
    holders = list(holders)
    if limit is None:
        return (np.where(is_request, _D, _I).astype(np.int8),
                np.full(n, len(holders), dtype=np.int32), holders)
    rel_pos = np.flatnonzero(~is_request)
    order = np.argsort(agents[rel_pos], kind="stable")
    rel_agents, rel_sorted = agents[rel_pos][order], rel_pos[order]
    req_pos = np.flatnonzero(is_request)

    def next_release(agent, start: int) -> int:
        lo = np.searchsorted(rel_agents, agent, "left")
        hi = np.searchsorted(rel_agents, agent, "right")
        k = lo + np.searchsorted(rel_sorted[lo:hi], start, "left")
        return int(rel_sorted[k]) if k < hi else n

    def next_change(start: int) -> int:
        nxt = min([next_release(a, start) for a in set(holders)], default=n)
        if len(holders) < limit:
            k = np.searchsorted(req_pos, start, "left")
            nxt = min(nxt, int(req_pos[k]) if k < len(req_pos) else n)
        return nxt

    ag, rq = agents.tolist(), is_request.tolist()
    code, after = [], []
    i, idle = 0, 0
    while i < n:
        if idle >= SKIP_AFTER:
            idle = 0
            nxt = next_change(i)
            if nxt > i:
                code.extend(np.where(is_request[i:nxt], _D, _I).tolist())
                after.extend([len(holders)] * (nxt - i))
                i = nxt
                continue
        a = ag[i]
        if rq[i]:
            if len(holders) < limit:
                holders.append(a)
                code.append(_G)
                idle = 0
            else:
                code.append(_D)
                idle += 1
        elif a in holders:
            holders.remove(a)
            code.append(_R)
            idle = 0
        else:
            code.append(_I)
            idle += 1
        after.append(len(holders))
        i += 1
    return np.array(code, dtype=np.int8), np.array(after, dtype=np.int32), holders


def _admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run the state machine over rows sorted by (resource_id, seq); a
    resource's rows may continue into the next Arrow batch."""
    cur, holders = object(), []
    for pdf in batches:
        if not len(pdf):
            continue
        res = pdf["resource_id"].to_numpy()
        agents = pdf["agent_id"].to_numpy()
        is_req = (pdf["action"] == "request").to_numpy()
        lim = pdf["max_concurrent"].to_numpy(dtype="float64", na_value=np.nan)
        code = np.empty(len(pdf), dtype=np.int8)
        after = np.empty(len(pdf), dtype=np.int32)
        starts = np.flatnonzero(np.r_[True, res[1:] != res[:-1]])
        ends = np.r_[starts[1:], len(pdf)]
        for s, e in zip(starts, ends):
            if res[s] != cur:
                cur, holders = res[s], []
            limit = None if np.isnan(lim[s]) else int(lim[s])
            c, a, holders = admit_run(agents[s:e], is_req[s:e], limit, holders)
            code[s:e], after[s:e] = c, a
        yield pd.DataFrame({"seq": pdf["seq"], "resource_id": pdf["resource_id"],
                            "agent_id": pdf["agent_id"], "action": pdf["action"],
                            "outcome": OUTCOMES[code], "holders_after": after})


def register_resources(log: DataFrame, seq: str = "seq") -> DataFrame:
    """S11 for resources: upsert a registration log ``(seq, resource_id,
    max_concurrent)`` by id; the last registration's limit wins (a partial
    ``max_by`` aggregate)."""
    return (log.groupBy("resource_id")
            .agg(F.max_by("max_concurrent", seq).alias("max_concurrent")))


def resource_admission(log: DataFrame, resources: DataFrame) -> DataFrame:
    """Outcome of every request / release in arrival order.

    ``resources`` holds one row per resource id (the registry after its
    upsert, S11); a resource missing from it is unregistered."""
    hot = log.groupBy("resource_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("resource_id")
    hot = [r[0] for r in hot.collect()]  # fewer than rows / HOT
    if not hot:
        return _admission_in_order(log, resources)
    from weft.operators.admission_chunks import hot_admission
    is_hot = F.coalesce(F.col("resource_id").isin(hot), F.lit(False))
    return hot_admission(log.where(is_hot), resources)[0].unionByName(_admission_in_order(log.where(~is_hot), resources))


def _admission_in_order(log: DataFrame, resources: DataFrame) -> DataFrame:
    x = (log.select("seq", "resource_id", "agent_id", "action")
         .join(resources.select("resource_id", "max_concurrent"), "resource_id", "left")
         .repartition("resource_id")
         # a total order, so a recomputed task sees the same sequence
         .sortWithinPartitions("resource_id", "seq", "action", "agent_id"))
    return x.mapInPandas(_admit, OUT_SCHEMA)


def tracked_resources(log: DataFrame, resources: DataFrame) -> DataFrame:
    """The registered resources requested at least once (no admission needed)."""
    asked = log.where(F.col("action") == "request").select("resource_id").distinct()
    return resources.join(asked, "resource_id", "left_semi")


def resource_utilization(admission: DataFrame, resources: DataFrame) -> DataFrame:
    """Current holders, limit and ratio for each registered resource
    requested at least once. Holders = grants - effective releases (a
    partial aggregate); a limit of 0 gives a null ratio."""
    o = F.col("outcome")
    agg = (admission.groupBy("resource_id").agg(
        (F.count_if(o == GRANTED) - F.count_if(o == RELEASED)).alias("current_users"),
        F.count_if(F.col("action") == "request").alias("__req")))
    return (agg.where(F.col("__req") > 0)
            .join(resources, "resource_id", "inner")
            .select("resource_id", F.col("current_users").cast("bigint").alias("current_users"),
                    "max_concurrent",
                    F.try_divide(F.col("current_users").cast("double"),
                                 F.col("max_concurrent").cast("double")).alias("utilization")))
