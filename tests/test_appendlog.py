"""Appends by token: twice the same, broken ones and two at once leave each row once."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from weft.operators import metrics as mt
from weft.operators import reports as rp
from weft.sources import appendlog as al


def ids(spark, path, schema="id long, k string"):
    return sorted(r["id"] for r in al.read_appends(spark, path, schema).collect())


def rows_of(spark, *values):
    return spark.createDataFrame([(v, "ab"[v % 2]) for v in values], "id long, k string")


def test_the_same_append_twice(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    assert ids(spark, path) == []
    assert al.append_once(rows_of(spark, 1, 2), path, "one", ["k"]) is True
    assert al.append_once(rows_of(spark, 1, 2), path, "one", ["k"]) is False
    assert al.append_once(rows_of(spark, 3), path, "two", ["k"]) is True
    assert ids(spark, path) == [1, 2, 3]
    kept = al.read_appends(spark, path, "id long, k string").where("k = 'a'")
    assert [r["id"] for r in kept.collect()] == [2]
    assert "PartitionFilters: [isnotnull(k" in kept._jdf.queryExecution().executedPlan().toString()


def test_broken_appends_are_never_read(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/t"
    al.append_once(rows_of(spark, 1), path, "one")
    bad = rows_of(spark, *range(5, 60)).repartition(4).withColumn("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        al.append_once(bad, path, "two")
    assert ids(spark, path) == [1]

    def crash(*a):
        raise RuntimeError("driver gone before the commit")

    with monkeypatch.context() as m:
        m.setattr(al, "_commit", crash)
        with pytest.raises(RuntimeError):
            al.append_once(rows_of(spark, 7), path, "three")
    assert ids(spark, path) == [1] and len(os.listdir(f"{path}/_appends")) == 3
    assert al.append_once(rows_of(spark, 7), path, "three") and al.append_once(rows_of(spark, 8), path, "two")
    assert ids(spark, path) == [1, 7, 8]


def test_two_writers_of_one_token(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/t"
    monkeypatch.setattr(al, "is_committed", lambda *a: False)  # both begin before either commits
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: al.append_once(rows_of(spark, 1, 2, 3), path, "same"), range(4)))
    assert sum(won) == 1 and ids(spark, path) == [1, 2, 3]
    assert len(os.listdir(f"{path}/_appends")) == 1  # the others' files are gone


def test_sinks_and_odd_tokens(spark, tmpdir_path):
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id long, ts timestamp")
    for _ in range(2):
        rp.append_history(e, f"{tmpdir_path}/h", token="batch-1")
        mt.append_samples(e.withColumn("metric", F.lit("m")), f"{tmpdir_path}/s", token="batch-1")
        rp.append_memory(rp.memory_episodes(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")),
                         f"{tmpdir_path}/m", token="b=1")
    assert al.read_appends(spark, f"{tmpdir_path}/h", "id long, ts timestamp, date date").count() == 2
    assert al.read_appends(spark, f"{tmpdir_path}/s", "id long, metric string").count() == 2
    assert al.read_appends(spark, f"{tmpdir_path}/m", "conv_id long, type string").collect()[0]["type"] == "user"
    for token in ("", "a/b", "../x", "_x", "a b"):
        with pytest.raises(ValueError):
            al.append_once(e, f"{tmpdir_path}/h", token)
