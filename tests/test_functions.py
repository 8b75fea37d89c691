"""Scalar helpers (F1-F16, P3-P9) on small literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from weft.functions import scalar as sc


def _one(spark, expr, data, schema):
    return spark.createDataFrame(data, schema).select(expr.alias("x")).collect()


def test_text_helpers(spark):
    rows = spark.createDataFrame([("", "event_task_completed", "a/b/c.tar.gz", "abcdefghij")],
                                 "t string, k string, p string, i string")
    r = rows.select(sc.line_count(F.col("t")).alias("lines"),
                    sc.line_count(F.lit("a\nb\n")).alias("lines2"),
                    sc.key_label(sc.strip_event_prefix(F.col("k"))).alias("label"),
                    sc.file_name(F.col("p")).alias("name"), sc.file_stem(F.col("p")).alias("stem"),
                    sc.short_id(F.col("i")).alias("sid"),
                    sc.language_of(F.lit("x/y.rs")).alias("lang"),
                    sc.language_of(F.lit("x/y.unknown")).alias("nolang")).collect()[0]
    assert (r["lines"], r["lines2"]) == (1, 3)
    assert r["label"] == "Task Completed"
    assert (r["name"], r["stem"]) == ("c.tar.gz", "c.tar")
    assert r["sid"] == "abcdefgh" and r["lang"] == "Rust" and r["nolang"] is None


def test_time_helpers(spark):
    t0, t1 = dt.datetime(2024, 3, 5, 7, 8, 9, 123456), dt.datetime(2024, 3, 5, 7, 9, 40, 623456)
    r = spark.createDataFrame([(t0, t1)], "a timestamp, b timestamp").select(
        sc.iso_text(F.col("a")).alias("iso"), sc.short_date(F.col("a")).alias("short"),
        sc.seconds_between(F.col("a"), F.col("b")).alias("secs")).collect()[0]
    assert r["iso"] == "2024-03-05T07:08:09.123456" and r["short"] == "03/05 07:08"
    assert r["secs"] == 91.5


def test_bands_and_stars(spark):
    data = [(-0.5, 0, 4), (6.9, 2, 7), (7.0, 0, 10), (12.3, 5, 25)]
    got = spark.createDataFrame(data, "score double, issues int, cx int").select(
        sc.stars(F.col("score")).alias("s"), sc.quality_band(F.col("score")).alias("q"),
        sc.issues_band(F.col("issues")).alias("i"), sc.complexity_band(F.col("cx")).alias("b"),
        sc.complexity_alert(F.col("cx")).alias("a")).collect()
    assert [r["s"] for r in got] == ["", "******", "*******", "**********"]
    assert [r["q"] for r in got] == ["warning", "warning", "success", "success"]
    assert [r["i"] for r in got] == ["success", "danger", "success", "danger"]
    assert [r["b"] for r in got] == ["green", "yellow", "red", "red"]
    assert [r["a"] for r in got] == ["ok", "ok", "warning", "critical"]


def test_lookup_ratio_clamp_numbering(spark):
    df = spark.createDataFrame([({"k": "v"}, 3, 0, ["a", "b", "c", "d"], None)],
                               "m map<string,string>, n int, z int, recs array<string>, s string")
    r = df.select(sc.get_or(F.col("m"), "k", "d").alias("hit"),
                  sc.get_or(F.col("m"), "x", "d").alias("miss"),
                  sc.ratio(F.col("n"), F.col("z")).alias("zero"),
                  sc.ratio(F.col("n"), F.lit(2)).alias("half"),
                  sc.clamp(F.col("n") * 5, 0, 10).alias("cl"),
                  sc.top_numbered(F.col("recs"), 3).alias("top"),
                  sc.or_na(F.col("s")).alias("na"),
                  F.array(sc.fixed1(F.lit(2.25)), sc.fixed1(F.lit(2.75))).alias("f")).collect()[0]
    assert (r["hit"], r["miss"], r["zero"], r["half"], r["cl"]) == ("v", "d", None, 1.5, 10)
    assert r["top"] == ["1. a", "2. b", "3. c"] and r["na"] == "N/A" and r["f"] == [f"{2.25:.1f}", f"{2.75:.1f}"]


def test_to_json_text(spark):
    r = spark.createDataFrame([(1, "a", None)], "n long, s string, z double").select(
        sc.to_json_text("n", "s", "z").alias("j")).collect()[0]
    assert r["j"] == '{"n":1,"s":"a"}'
