from conftest import rows
from fixtures import ts
from weft.operators import metrics as mt
from weft.operators import resources as rsc


def test_admission_quirks(spark):
    res = spark.createDataFrame([(1, 1), (2, 0), (3, 2), (4, 1)],
                                "resource_id long, max_concurrent int")
    log = spark.createDataFrame([
        (1, 1, 10, "request"), (2, 1, 11, "request"),    # full: denied
        (3, 1, 11, "release"),                           # non-holder: ignored
        (4, 1, 10, "release"), (5, 1, 11, "request"),
        (6, 2, 10, "request"),                           # limit 0
        (7, 3, 10, "request"), (8, 3, 10, "request"),    # same agent twice
        (9, 3, 10, "release"),
        (10, 9, 10, "request"),                          # unregistered
    ], "seq long, resource_id long, agent_id long, action string")
    adm = rsc.resource_admission(log, res)
    got = rows(adm, "seq", "outcome", "holders_after")
    assert got == [(1, "granted", 1), (2, "denied", 1), (3, "ignored", 1), (4, "released", 0),
                   (5, "granted", 1), (6, "denied", 0), (7, "granted", 1), (8, "granted", 2),
                   (9, "released", 1), (10, "denied", 0)]
    util = rows(rsc.resource_utilization(adm, res), "resource_id", "current_users", "utilization")
    # resource 4 never requested -> not listed; limit 0 -> null ratio; 9 unregistered
    assert util == [(1, 1, 1.0), (2, 0, None), (3, 1, 0.5)]


def test_register_resources_last_wins(spark):
    log = spark.createDataFrame([(1, 7, 1), (2, 8, 2), (3, 7, 3)],
                                "seq long, resource_id long, max_concurrent int")
    assert rows(rsc.register_resources(log), "resource_id", "max_concurrent") == [(7, 3), (8, 2)]


def test_agent_metric_stats_exact_keys(spark):
    data = [(i, "a", "lat", ts(i), float(i)) for i in range(1, 13)]
    data += [(100, "a.b", "lat", ts(100), 99.0)]
    data += [(101, "a", "cpu", ts(101), 5.0)]
    df = spark.createDataFrame(data, "seq long, agent_id string, metric string, ts timestamp, value double")
    got = {(r["agent_id"], r["metric"]): r for r in mt.agent_metric_stats(df).collect()}
    a = got[("a", "lat")]
    assert (a["current"], a["min"], a["max"], a["n"]) == (12.0, 3.0, 12.0, 10)
    assert float(a["average"]) == 7.5
    assert got[("a.b", "lat")]["n"] == 1 and got[("a", "cpu")]["n"] == 1


def test_system_stats_last_1000_across_metrics(spark):
    data = [(i, "m1" if i % 2 else "m2", ts(i), float(i)) for i in range(1, 1201)]
    df = spark.createDataFrame(data, "seq long, metric string, ts timestamp, value double")
    got = {r["metric"]: r for r in mt.system_metric_stats(df).collect()}
    assert got["m1"]["n"] + got["m2"]["n"] == 1000
    assert got["m2"]["current"] == 1200.0 and got["m1"]["min"] == 201.0


def test_uptime_empty_is_zero(spark):
    df = spark.createDataFrame([], "ts timestamp")
    assert mt.uptime_seconds(df).collect()[0]["uptime_seconds"] == 0.0


def _naive(events, limit):
    holders, out = [], []
    for agent, req in events:
        if limit is None:
            out.append(("denied" if req else "ignored", 0))
            continue
        if req:
            if len(holders) < limit:
                holders.append(agent)
                out.append(("granted", len(holders)))
            else:
                out.append(("denied", len(holders)))
        elif agent in holders:
            holders.remove(agent)
            out.append(("released", len(holders)))
        else:
            out.append(("ignored", len(holders)))
    return out


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
import numpy as np  # noqa: E402


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), max_size=80),
       st.one_of(st.none(), st.integers(0, 4)))
def test_admit_run_equals_naive(events, limit):
    """The skipping state machine equals the step-by-step one."""
    agents = np.array([a for a, _ in events], dtype=np.int64)
    is_req = np.array([r for _, r in events], dtype=bool)
    code, after, _ = rsc.admit_run(agents, is_req, limit, [])
    got = [(rsc.OUTCOMES[c], int(h)) for c, h in zip(code, after)]
    assert got == _naive(events, limit)
