import numpy as np
import pytest

from conftest import rows
from weft.operators import similarity as sim


def _vectors(spark, n=120, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[10] = x[3] + 0.05 * rng.standard_normal(dim)   # near copy
    x[11] = x[3]                                     # exact copy
    x[50] = x[40] + 0.1 * rng.standard_normal(dim)
    for j in range(60, 90):                           # dense cluster of near copies
        x[j] = x[5] + 0.04 * rng.standard_normal(dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, [float(v) for v in x[i]], i % 4) for i in range(n)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), \
        x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_consolidation_equals_brute_force(spark, seed):
    df, x = _vectors(spark, seed=seed)
    s = x @ x.T
    want = {}
    for i in range(len(x)):
        partners = [j for j in range(len(x)) if j != i and s[i, j] >= 0.95]
        want[i] = min([i] + partners)
    got = dict(rows(sim.consolidate_near_duplicates(df), "vec_id", "canonical_id"))
    assert got == want and got[10] == 3 and got[11] == 3
    assert sum(1 for j in range(60, 90) if got[j] == 5) >= 25


def test_consolidation_of_text_ids(spark):
    df, x = _vectors(spark)
    named = df.selectExpr("format_string('v%03d', vec_id) AS vec_id", "embedding")
    want = {f"v{i:03d}": f"v{j:03d}" for i, j in rows(sim.consolidate_near_duplicates(df), "vec_id", "canonical_id")}
    assert dict(rows(sim.consolidate_near_duplicates(named), "vec_id", "canonical_id")) == want


def test_candidates_per_vector_stay_flat():
    for n in (10 ** 3, 10 ** 5, 10 ** 7, 10 ** 9):
        bits, tables = sim.lsh_shape(n, 0.95, 1e-6)
        assert n / 2 ** bits <= 8 and tables < 40 * (n / 1000) ** 0.16  # grows as n^0.153


def test_query_sets_larger_than_a_block(spark):
    df, x = _vectors(spark)
    rng = np.random.default_rng(1)
    q = rng.standard_normal((5000, 16))
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, qvec array<double>")
    got = {}
    for r in sim.vector_topk(df, queries, k=3, threshold=None).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    score = q @ x.T
    for i in range(5000):
        assert [v for _, v in sorted(got[i])] == sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:3]


def test_topk_equals_numpy(spark):
    df, x = _vectors(spark)
    q = spark.createDataFrame([(0, [float(v) for v in x[3]]), (1, [float(v) for v in x[40]])],
                              "qid long, qvec array<double>")
    got = sim.vector_topk(df, q, k=5, threshold=None).collect()
    for qi, row in [(0, 3), (1, 40)]:
        order = sorted(range(len(x)), key=lambda j: (-float(x[j] @ x[row]), j))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == qi] == order


def test_majority_vote_tie_to_smallest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3), ("b", 1)], "item string, label int")
    assert rows(sim.majority_vote(df, "item", "label"), "item", "label", "votes") == [("a", 1, 1), ("b", 3, 2)]


def test_majority_vote_of_text_labels(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("b", "z"), ("b", "x")], "item string, label string")
    assert rows(sim.majority_vote(df, "item", "label"), "item", "label", "votes") == [("a", "x", 1), ("b", "z", 2)]


def test_label_centroids_are_unit_means(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 1.0], 7), (3, [0.0, 2.0], 8)],
                               "vec_id long, embedding array<float>, label int")
    got = {r["label"]: r["centroid"] for r in sim.label_centroids(df).collect()}
    assert np.allclose(got[7], [2 ** -0.5, 2 ** -0.5]) and np.allclose(got[8], [0.0, 1.0])


def test_plan_does_not_grow_with_the_queries(spark):
    df, x = _vectors(spark)
    rng = np.random.default_rng(2)

    def plan(n):
        q = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((n, 16)))], "qid long, qvec array<double>")
        return sim.vector_topk(df, q, k=3, threshold=None)._jdf.queryExecution().optimizedPlan().toString()

    assert abs(len(plan(3)) - len(plan(4000))) < 50


def test_topk_with_ties_nulls_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sim, "QUERY_BLOCK", 3)
    data = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(8)] + [("n", None)], "qid string, qvec array<double>")
    got = {}
    for r in sim.vector_topk(df, q, k=4, threshold=0.5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got.keys() == {f"q{i}" for i in range(8)}
    assert all(sorted(v) == [(1, 1), (2, 2), (3, 4), (4, 5)] for v in got.values())
    assert sim.vector_topk(df, q.where("false"), k=4).count() == 0
    assert sim.vector_topk(df.where("false"), q, k=4).count() == 0


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_consolidation_sends_no_pairs(spark, part_rows):
    """Beyond the first ids, with over-full buckets cut into parts: brute force's
    answer, although half the vectors are copies of one late vector."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 8))
    x[700:] = x[650] + 0.02 * rng.standard_normal((500, 8))
    x[400:460] = x[30] + 0.13 * rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    want = [(i, int(np.flatnonzero(near[i, :i + 1])[0])) for i in range(len(x))]
    out = sim.consolidate_near_duplicates(df, first=20, part_rows=part_rows, miss=1e-9)
    assert rows(out, "vec_id", "canonical_id") == want
    groups = sim.consolidate_near_duplicates(df.withColumn("vec_id", F.col("vec_id") % 600), first=20, part_rows=part_rows, miss=1e-9)
    assert groups.count() == 1200


def test_vectors_of_few_dimensions_are_settled_by_the_first_ids(spark, monkeypatch):
    """Every vector is near hundreds of others; no bucket is needed to find the smallest."""
    monkeypatch.setattr(sim, "_bucket_partners", lambda *a: pytest.fail("open vectors"))
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = dict(rows(sim.consolidate_near_duplicates(df), "vec_id", "canonical_id"))
    near = x @ x.T >= 0.95
    assert got == {i: int(np.flatnonzero(near[i, :i + 1])[0]) for i in range(len(x))}
