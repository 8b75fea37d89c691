"""A hot resource's log in chunks equals the loop over it, whatever the guesses."""

import random

import pytest

from conftest import rows
from weft.operators import resources as rsc
from weft.operators.admission_chunks import hot_admission
from test_resources_metrics import _naive

LOG = "seq long, resource_id long, agent_id long, action string"


def log_of(seed, n, agents, stuck=0, resources=(7, 8)):
    """Requests and releases; the first ``stuck`` agents request at once and never release."""
    r = random.Random(seed)
    out = [(i + 1, resources[0], 1000 + i, "request") for i in range(stuck)]
    while len(out) < n:
        out.append((len(out) + 1, r.choice(resources), r.randrange(agents), r.choice(["request", "release", "release"])))
    return [(s * 3, *x) for s, *x in out]


def want(log, limits):
    out = []
    for res in {x[1] for x in log}:
        own = sorted(x for x in log if x[1] == res)
        out += [(s, res, a, k, *o) for (s, _, a, k), o in zip(own, _naive([(a, k == "request") for _, _, a, k in own], limits.get(res)))]
    return sorted(out)


def frames(spark, log, limits):
    return spark.createDataFrame(log, LOG).repartition(5), spark.createDataFrame([(k, v) for k, v in limits.items()], "resource_id long, max_concurrent int")


@pytest.mark.parametrize("seed, stuck, limit, warm", [(1, 0, 2, 40), (2, 0, 3, 5), (3, 2, 3, 40), (4, 1, 1, 0), (5, 0, 0, 10)])
def test_chunks_equal_the_loop(spark, seed, stuck, limit, warm):
    log, limits = log_of(seed, 900, 6, stuck), {7: limit, 8: 2}
    out, chunks = hot_admission(*frames(spark, log, limits), chunk=60, warm=warm, rounds=2)
    assert sorted(tuple(r) for r in out.collect()) == want(log, limits)
    settled = rows(chunks, "round")
    assert len(settled) >= 14
    if not stuck and warm >= 40:  # short memory: nearly every guess is right, and chunks run at the same time
        assert sum(r == (0,) for r in settled) > 0.7 * len(settled)
    if stuck == 2:  # one free place, two holders that never leave: no guess can know them
        assert (-1,) in settled


def test_unregistered_and_short_logs(spark):
    log = log_of(6, 130, 4, resources=(7, 9))
    out, _ = hot_admission(*frames(spark, log, {7: 1}), chunk=50, warm=10)
    assert sorted(tuple(r) for r in out.collect()) == want(log, {7: 1})
    out, chunks = hot_admission(*frames(spark, log[:20], {7: 1}), chunk=50, warm=10)
    assert sorted(tuple(r) for r in out.collect()) == want(log[:20], {7: 1}) and {r for r in rows(chunks, "round")} == {(0,)}


def test_hot_and_cold_resources_together(spark, monkeypatch):
    monkeypatch.setattr(rsc, "HOT", 200)
    log = log_of(8, 700, 5, resources=(7, 7, 7, 8, 9))
    limits = {7: 2, 8: 1}
    got = rsc.resource_admission(*frames(spark, log, limits))
    assert sorted(tuple(r) for r in got.collect()) == want(log, limits)
    again = rsc.resource_admission(*frames(spark, [(s, None if r == 9 else r, a, k) for s, r, a, k in log], limits))
    assert again.count() == 700
