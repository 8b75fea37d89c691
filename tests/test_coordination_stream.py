"""Registrations and events in one stream, against a plain loop, over several
micro-batches and a restart."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from fixtures import EVENT_SCHEMA, event
from weft.session import scratch_path
from weft.streaming import queries as sq
from weft.streaming.sources import read_batches, run_batches, with_event_time

LIMIT = 90.0


def plain(events):
    """(silences, final states) by a loop over the events in order."""
    agents, silences = {}, []

    def check(a, now):
        s = agents[a]
        if now - s["heard"] > LIMIT:
            if s["state"] != "error":
                silences.append((a, s["heard"]))
            s["state"] = "error"

    for e in sorted(events, key=lambda e: e[0]):
        seq, et, a, t, ns, task = e[0], e[2], e[3], (e[6] - event(0, "", "", t=0)[6]).total_seconds(), e[7], e[8]
        if a in agents:
            check(a, t)
        if ns == "registered":
            agents[a] = {"state": "idle", "load": 0, "heard": max(t, agents[a]["heard"]) if a in agents else t, "seq": seq}
            continue
        if a not in agents:
            continue
        s = agents[a]
        s["heard"], s["seq"] = max(s["heard"], t), seq
        if et == "agent_state_changed" and ns in ("busy", "idle", "unresponsive"):
            s["state"] = "error" if ns == "unresponsive" else ns
            s["load"] = min(10, s["load"] + 1) if ns == "busy" else s["load"]
        elif et == "task_completed" and task:
            s["state"], s["load"] = "idle", max(0, s["load"] - 1)
        elif et == "task_failed" and task:
            s["state"] = "error"
    end = max((e[6] - event(0, "", "", t=0)[6]).total_seconds() for e in events)
    for a in agents:
        check(a, end)
    return sorted(silences), sorted((a, s["state"], s["load"], s["seq"]) for a, s in agents.items())


def stream_of(spark, folder):
    return with_event_time(spark.readStream.schema(spark.createDataFrame([], EVENT_SCHEMA).schema)
                           .option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder))


def write(spark, folder, name, events):
    spark.createDataFrame(events, EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")
    time.sleep(0.05)


def outcome(spark, out):
    df = read_batches(spark, out, sq.COORDINATION.replace("agent_id long", "agent_id string"))
    zero = event(0, "", "", t=0)[6]
    silences = sorted((r["agent_id"], (r["last_seen"] - zero).total_seconds()) for r in df.where("kind = 'silence'").collect())
    return silences, sorted((r["agent_id"], r["state"], r["load_tenths"], r["last_seq"]) for r in sq.latest_agent_states(df).collect())


def story(seed, n=400):
    r = random.Random(seed)
    out, t = [], 0.0
    names = [f"a{i}" for i in range(7)]
    for seq in range(1, n):
        t += r.choice([1, 5, 20, 45])
        a = r.choice(names)
        kind = r.random()
        if kind < 0.06:
            out.append(event(seq, "agent_state_changed", a if r.random() < 0.7 else f"quiet{seq}", "registered", t=t))
        elif kind < 0.5:
            out.append(event(seq, "agent_state_changed", a, r.choice(["busy", "busy", "idle", "odd", "unresponsive"]), t=t))
        else:
            out.append(event(seq, r.choice(["task_completed", "task_failed", "task_assigned"]), a, task_id=r.choice(["t", None]), t=t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_the_loop_over_batches_and_a_restart(spark, seed):
    events = story(seed)
    folder, base = scratch_path(spark, f"co-{uuid.uuid4().hex[:8]}"), scratch_path(spark, f"cob-{uuid.uuid4().hex[:8]}")
    cut = [0, 90, 170, 171, 300, len(events)]
    for i in range(3):
        write(spark, folder, f"b{i}", events[cut[i]:cut[i + 1]])
    run_batches(sq.stream_coordination(stream_of(spark, folder)), "co", "update", base=base)
    for i in range(3, 5):  # a new run goes on from the stored state
        write(spark, folder, f"b{i}", events[cut[i]:cut[i + 1]])
    out = run_batches(sq.stream_coordination(stream_of(spark, folder)), "co", "update", base=base)
    assert read_batches(spark, out, sq.COORDINATION.replace("agent_id long", "agent_id string")).where("batch_id >= 0").select("batch_id").distinct().count() > 4
    got, want = outcome(spark, out), plain(events)
    assert got == want
    assert any(a.startswith("quiet") for a, _ in want[0])


def test_registration_midway_and_silence_from_registration_on(spark):
    events = [event(1, "agent_state_changed", "late", "busy", t=0),      # not registered yet: ignored
              event(2, "agent_state_changed", "late", "registered", t=10),
              event(3, "agent_state_changed", "mute", "registered", t=10),
              event(4, "agent_state_changed", "late", "busy", t=100),    # exactly 90 s: no silence
              event(5, "agent_state_changed", "late", "busy", t=110),
              event(6, "agent_state_changed", "late", "registered", t=120),  # starts afresh
              event(7, "x", "stranger", t=500)]
    folder = scratch_path(spark, f"co-{uuid.uuid4().hex[:8]}")
    write(spark, folder, "b0", events[:4])
    write(spark, folder, "b1", events[4:])
    silences, states = outcome(spark, run_batches(sq.stream_coordination(stream_of(spark, folder)), "co", "update"))
    assert silences == [("late", 120.0), ("mute", 10.0)]
    assert states == [("late", "error", 0, 6), ("mute", "error", 0, 3)]
    assert (silences, states) == plain(events)
