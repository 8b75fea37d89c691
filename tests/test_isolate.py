"""Row-level isolation: a failing row costs its own result and no other."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from weft.operators import reports as rp
from weft.plans import isolate


def breaks_on(bad):
    def analyzer(d):
        return d.select("doc_id", F.when(bad, F.raise_error(F.concat(F.lit("bad "), F.col("n").cast("string"))))
                        .otherwise(F.col("n").cast("string")).alias("detail"))
    return analyzer


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 3).alias("n"))


def test_one_bad_row_in_ten_thousand(spark):
    docs = numbered(spark, 10_000)
    out = rp.combine_analyzers(docs, {"sound": breaks_on(F.lit(False)), "a": breaks_on(F.col("doc_id") == 4321),
                                      "b": breaks_on(F.col("doc_id").isin(0, 9999, 5000))})
    st = rows(out.groupBy("analyzer", "status").count(), "analyzer", "status", "count")
    assert st == [("a", "error", 1), ("a", "ok", 9999), ("b", "error", 3), ("b", "ok", 9997), ("sound", "ok", 10_000)]
    bad = out.where("status = 'error'").collect()
    assert {(r["analyzer"], r["doc_id"]) for r in bad} == {("a", 4321), ("b", 0), ("b", 9999), ("b", 5000)}
    assert all(f"bad {3 * r['doc_id']}" in r["error"] and r["detail"] is None for r in bad)
    assert out.where("status = 'ok' AND detail != cast(doc_id * 3 AS string)").count() == 0


def test_passes_grow_with_the_logarithm(spark, tmpdir_path):
    docs, levels = numbered(spark, 10_000), []
    calls = []

    def step(d):
        calls.append(1)
        return breaks_on(F.col("doc_id") == 77)(d)

    def places():
        return isolate.spread(docs, "doc_id", f"{tmpdir_path}/rows")

    out = isolate.run_isolated(docs, step, f"{tmpdir_path}/run", places, 10)
    levels = {d.split("-")[0] for d in os.listdir(f"{tmpdir_path}/run") if "-" in d}
    assert len(out.failed) == 1 and out.failed[0][0] == out.failed[0][1] and not out.gave_up
    assert len(levels) <= 5 and len(calls) <= 2 + 16 * 5
    calls.clear()
    sound = isolate.run_isolated(docs, lambda d: calls.append(1) or breaks_on(F.lit(False))(d), f"{tmpdir_path}/sound", places, 10)
    assert len(calls) == 1 and sound.paths == [f"{tmpdir_path}/sound/all"] and not sound.failed


@pytest.mark.parametrize("most", [5, 40])
def test_an_analyzer_that_keeps_failing_is_given_up(spark, most):
    """Rows that passed before stand; the others are error rows, each once."""
    docs = numbered(spark, 120)
    out = rp.combine_analyzers(docs, {"x": breaks_on(F.col("doc_id") % 2 == 0)}, max_errors=most)
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("status").alias("s")).collect()
    assert len(got) == 120 and {r["n"] for r in got} == {1}
    assert all(r["s"] == "error" for r in got if r["doc_id"] % 2 == 0)
    exact = rp.combine_analyzers(docs, {"x": breaks_on(F.col("doc_id") % 50 == 0)}, max_errors=500)
    assert exact.where("status = 'error'").count() == 3


def test_keys_that_are_null_or_repeated_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4), (6, 5)], "doc_id long, n long")
    out = rp.combine_analyzers(docs, {"x": breaks_on(F.col("n").isin(1, 4))})
    assert sorted((str(r["doc_id"]), r["status"]) for r in out.collect()) == [
        ("5", "error"), ("5", "error"), ("6", "ok"), ("None", "error"), ("None", "error")]
    assert rp.combine_analyzers(docs.where("false"), {"x": breaks_on(F.lit(True))}).count() == 0
    always = rp.combine_analyzers(docs, {"x": lambda d: d.select("doc_id", F.expr("assert_true(1 = 2)").cast("string").alias("detail"))})
    assert always.where("status = 'error'").count() == 5


@pytest.mark.parametrize("bad", [40, 900])
def test_passes_do_not_grow_with_the_failing_rows(spark, tmpdir_path, bad):
    """Many failing rows, more than ``max_errors``: found in one pass, the others all pass."""
    docs, calls = numbered(spark, 3000), []

    def step(d):
        calls.append(1)
        return breaks_on(F.col("doc_id") % 3000 < bad)(d)

    out = isolate.run_isolated(docs, step, f"{tmpdir_path}/run", lambda: isolate.spread(docs, "doc_id", f"{tmpdir_path}/rows"), 30)
    assert len(calls) <= 4 + isolate.OWN_MESSAGES and not out.gave_up
    failed = isolate.failed_rows(out).collect()
    assert sorted(r["doc_id"] for r in failed) == list(range(bad)) and all("bad " in r["error"] for r in failed)
    if bad <= isolate.OWN_MESSAGES:
        assert all(f"bad {3 * r['doc_id']}" in r["error"] for r in failed)
    assert rows(spark.read.parquet(*out.paths), "doc_id") == [(i,) for i in range(bad, 3000)]


def test_failures_that_no_sieve_reaches_are_searched(spark):
    def python(d):
        return d.select("doc_id", F.udf(lambda n: str(1 // (n - 300)))("n").alias("detail"))

    def elsewhere(d):
        broken = F.when(F.col("doc_id") == 7, F.raise_error(F.lit("seven"))).otherwise(F.lit(1))
        return d.withColumn("x", broken).where("x = 1").select("doc_id", F.col("n").cast("string").alias("detail"))

    out = rp.combine_analyzers(numbered(spark, 200), {"python": python, "elsewhere": elsewhere})
    assert rows(out.where("status = 'error'"), "analyzer", "doc_id") == [("elsewhere", 7), ("python", 100)]
    assert out.where("status = 'ok'").count() == 398
