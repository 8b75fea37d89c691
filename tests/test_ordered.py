"""The bucketed order helpers equal their single-window definitions even
when a key spans many seq buckets."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from weft.plans.ordered import apply_clamp, clamp_fold, compose_clamps_np, previous_within, rank_within


def _data(spark, n=400, keys=3, seed=1):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(10_000), n)
    data = [(rnd.randrange(keys), s, rnd.randrange(4), float(rnd.random())) for s in seqs]
    # one hot key with most of the rows
    data += [(99, 20_000 + i, rnd.randrange(2), 0.5) for i in range(300)]
    return spark.createDataFrame(data, "k long, seq long, p int, v double")


def test_rank_within_matches_row_number(spark):
    df = _data(spark)
    got = rank_within(df, ["k"], "seq", order=[("p", False)], name="r", bits=3)
    w = Window.partitionBy("k").orderBy(F.col("p").desc(), "seq")
    want = df.withColumn("r", F.row_number().over(w))
    assert rows(got, "k", "seq", "r") == rows(want, "k", "seq", "r")


def test_rank_within_global(spark):
    df = _data(spark)
    got = rank_within(df, [], "seq", order=[("p", True)], name="r", bits=4)
    want = df.withColumn("r", F.row_number().over(Window.orderBy("p", "seq")))
    assert rows(got, "seq", "r") == rows(want, "seq", "r")


def test_previous_within_matches_lag(spark):
    df = _data(spark)
    got = previous_within(df, ["k"], "seq", ["v"], bits=3)
    w = Window.partitionBy("k").orderBy("seq")
    want = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_seq", F.lag("seq").over(w))
    assert rows(got, "k", "seq", "prev_v", "prev_seq") == rows(want, "k", "seq", "prev_v", "prev_seq")


def _sequential(start, steps, lo, hi):
    x = start
    for d in steps:
        x = min(hi, max(lo, x + d))
    return x


def test_clamp_fold_matches_sequential(spark):
    rnd = random.Random(5)
    data, expect = [], {}
    for k in range(6):
        steps = [rnd.choice([-1, 1, 2, -3]) for _ in range(rnd.randrange(1, 200))]
        seqs = sorted(rnd.sample(range(5000), len(steps)))
        data += [(k, s, d) for s, d in zip(seqs, steps)]
        expect[k] = _sequential(3, steps, 0, 10)
    df = spark.createDataFrame(data, "k long, seq long, d int").withColumn("lo", F.lit(0)) \
        .withColumn("hi", F.lit(10))
    f = clamp_fold(df, ["k"], "seq", "d", "lo", "hi", levels=(2, 5))
    got = f.select("k", apply_clamp(F.lit(3).cast("bigint"), F.col("D"), F.col("L"), F.col("H"))
                   .alias("x")).collect()
    assert {r["k"]: r["x"] for r in got} == expect


def _compose(a, b):
    d1, l1, h1 = a
    d2, l2, h2 = b
    c = lambda v: min(h2, max(l2, v))
    return (d1 + d2, c(l1 + d2), c(h1 + d2))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-5, 5), st.integers(0, 8)),
                min_size=1, max_size=40), st.integers(-20, 20))
def test_clamp_composition_property(steps, start):
    """Composing clamp maps in any bracketing equals the sequential fold."""
    maps = [(d, lo, lo + w) for d, lo, w in steps]
    seq = start
    for d, lo, hi in maps:
        seq = min(hi, max(lo, seq + d))
    acc = (0, -10**9, 10**9)
    for m in maps:
        acc = _compose(acc, m)
    assert min(acc[2], max(acc[1], start + acc[0])) == seq
    mid = len(maps) // 2
    left, right = (0, -10**9, 10**9), (0, -10**9, 10**9)
    for m in maps[:mid]:
        left = _compose(left, m)
    for m in maps[mid:]:
        right = _compose(right, m)
    tot = _compose(left, right)
    assert min(tot[2], max(tot[1], start + tot[0])) == seq


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-5, 5), st.integers(0, 8)),
                max_size=60), st.integers(-20, 20))
def test_numpy_clamp_composition(steps, start):
    """The vectorised tree composition equals the sequential fold."""
    d = [x[0] for x in steps]
    lo = [x[1] for x in steps]
    hi = [x[1] + x[2] for x in steps]
    seq = start
    for a, b, c in zip(d, lo, hi):
        seq = min(c, max(b, seq + a))
    D, L, H = compose_clamps_np(d, lo, hi)
    assert min(H, max(L, start + D)) == seq


def test_default_buckets_with_a_hot_key(spark):
    """Default 2**16 buckets: one key holds most rows and spans several
    buckets; rank and previous-row equal their single-window forms."""
    hot = spark.range(200_000).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("seq"),
                                      (F.col("id") % 3).cast("int").alias("p"))
    cold = spark.range(30_000).select((1 + F.col("id") % 50).alias("k"),
                                      (F.col("id") * 7 + 3).alias("seq"),
                                      (F.col("id") % 2).cast("int").alias("p"))
    df = hot.unionByName(cold)
    got = rank_within(df, ["k"], "seq", order=[("p", False)], name="r")
    want = df.withColumn("r", F.row_number().over(
        Window.partitionBy("k").orderBy(F.col("p").desc(), "seq")))
    diff = got.select("k", "seq", "r").exceptAll(want.select("k", "seq", "r")).count()
    assert diff == 0 and got.count() == 230_000
    prev = previous_within(df.withColumn("v", F.col("seq") * 2), ["k"], "seq", ["v"])
    wp = df.withColumn("v", F.col("seq") * 2).withColumn(
        "prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    assert prev.select("k", "seq", "prev_v").exceptAll(wp.select("k", "seq", "prev_v")).count() == 0


def test_clamp_fold_default_levels_hot_key(spark):
    """Default levels (2**16, 2**32): one key with 150k steps over three
    buckets equals the sequential fold."""
    import numpy as np
    rng = np.random.default_rng(11)
    d = rng.choice([-1, 1, 1], size=150_000)
    seq = _sequential(4, d.tolist(), 0, 10)
    pdf_rows = [(0, i, int(x)) for i, x in enumerate(d)]
    df = spark.createDataFrame(pdf_rows, "k long, seq long, d int") \
        .withColumn("lo", F.lit(0)).withColumn("hi", F.lit(10))
    f = clamp_fold(df, ["k"], "seq", "d", "lo", "hi")
    got = f.select(apply_clamp(F.lit(4).cast("bigint"), F.col("D"), F.col("L"), F.col("H"))
                   .alias("x")).collect()[0]["x"]
    assert got == seq
