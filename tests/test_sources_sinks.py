import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weft.operators import metrics as mt
from weft.operators import reports as rp
from weft.sources.tables import load
from weft.sources.tabular import convert_format, read_tabular


def test_convert_and_read_back(spark, tmpdir_path):
    src = f"{SF_SMALL}/nation.parquet"
    dst = os.path.join(tmpdir_path, "nation_csv")
    convert_format(spark, "parquet", src, "csv", dst, partition_by=["n_regionkey"])
    schema = "n_nationkey int, n_name string"
    back = read_tabular(spark, "csv", dst, schema=schema + ", n_regionkey int")
    assert back.count() == 25
    assert sorted(r["n_regionkey"] for r in back.select("n_regionkey").distinct().collect()) == [0, 1, 2, 3, 4]
    jdst = os.path.join(tmpdir_path, "nation_json")
    convert_format(spark, "parquet", src, "json", jdst)
    assert read_tabular(spark, "json", jdst, schema="n_nationkey int, n_name string").count() == 25


def test_write_json_and_text(spark, tmpdir_path):
    ev = load(spark, SF_SMALL, "events").limit(5)
    rp.write_json(ev, os.path.join(tmpdir_path, "j"))
    files = [f for f in os.listdir(os.path.join(tmpdir_path, "j")) if f.endswith(".json")]
    line = open(os.path.join(tmpdir_path, "j", files[0])).readline()
    assert "T" in json.loads(line)["ts"]
    rp.write_text(ev.select(F.col("event_type").alias("t")), "t", os.path.join(tmpdir_path, "t"))
    assert spark.read.text(os.path.join(tmpdir_path, "t")).count() == 5


def test_append_history_and_samples(spark, tmpdir_path):
    ev = load(spark, SF_SMALL, "events").limit(10)
    h = os.path.join(tmpdir_path, "hist")
    rp.append_history(ev, h)
    rp.append_history(ev, h)
    assert spark.read.parquet(h).count() == 20
    s = os.path.join(tmpdir_path, "samples")
    mt.append_samples(ev.select("event_id", F.col("event_type").alias("metric"), "value"), s)
    assert spark.read.parquet(s).where(F.col("metric") == "click").count() >= 0


def test_memory_append_and_lookup(spark, tmpdir_path):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello")],
                                  "conv_id long, turn long, role string, text string")
    ep = rp.memory_episodes(turns)
    path = os.path.join(tmpdir_path, "memory")
    rp.append_memory(ep, path)
    rp.append_memory(ep, path)
    back = spark.read.parquet(path)
    assert back.where(F.col("type") == "user").count() == 2
    assert [r["content"] for r in rp.episodes_of_type(ep, "assistant").collect()] == ["hello"]


def test_expiry_prunes_date_partitions(spark, tmpdir_path):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(20)]
    h = os.path.join(tmpdir_path, "hist_prune")
    rp.append_history(spark.createDataFrame(rows, "id long, ts timestamp"), h)
    back = spark.read.parquet(h)
    as_of = F.lit(dt.datetime(2024, 1, 20)).cast("timestamp")
    kept = rp.exclude_expired(back, as_of, 7, partition_col="date")
    assert sorted(r["id"] for r in kept.collect()) == list(range(12, 20))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan.split("PartitionFilters")[1][:200]


def test_orc_and_text_formats(spark, tmpdir_path):
    src = f"{SF_SMALL}/nation.parquet"
    orc = os.path.join(tmpdir_path, "nation_orc")
    convert_format(spark, "parquet", src, "orc", orc)
    back = read_tabular(spark, "orc", orc, schema="n_nationkey int, n_name string, n_regionkey int")
    assert back.count() == 25 and back.where(F.col("n_regionkey") == 0).count() >= 1
    txt = os.path.join(tmpdir_path, "names_txt")
    load(spark, SF_SMALL, "nation").select("n_name").write.text(txt)
    assert read_tabular(spark, "text", txt).count() == 25
