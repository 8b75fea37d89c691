"""Cleaning, validation, normalization and profiling on hand-written rows."""

from pyspark.sql import functions as F

from conftest import rows
from weft.operators import cleaning as cl

SCHEMA = "k long, n int, name string, price double"


def _df(spark):
    return spark.createDataFrame([
        (1, 1, "  a ", 10.0),
        (1, 1, "b", 5.0),          # duplicate key: the smaller row wins
        (2, 1, None, 7.0),
        (3, 1, "c", None),         # missing required price: dropped
        (4, 1, "d", 7.0),
    ], SCHEMA)


def test_clean_trims_drops_and_dedups(spark):
    got = rows(cl.clean(_df(spark), ["k", "n"], ["price"]), "k", "name", "price")
    assert got == [(1, "a", 10.0), (2, None, 7.0), (4, "d", 7.0)]


def test_validate_counts_nulls_as_failures(spark):
    rules = {"price_positive": F.col("price") > 0, "name_present": F.col("name").isNotNull()}
    got = rows(cl.validate(_df(spark), rules, ["k"]), "k", "rule")
    assert got == [(2, "name_present"), (3, "price_positive")]
    steps = [("named", lambda d: d.where("name is not null")), ("same", lambda d: d)]
    summary = cl.run_summary(_df(spark), steps, cl.valid_flag(rules)).collect()[0]
    assert (summary["records_processed"], summary["records_kept"], summary["valid_records"]) == (5, 4, 3)
    assert float(summary["valid_share"]) == 0.75 and summary["steps_applied"] == "named, same"


def test_normalize_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "k long, x double")
    got = cl.normalize(df, "x").collect()
    assert all(r["x_minmax"] is None and r["x_z"] is None for r in got)
    df2 = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "k long, x double")
    got2 = {r["k"]: (float(r["x_minmax"]), float(r["x_z"])) for r in cl.normalize(df2, "x").collect()}
    assert got2 == {1: (0.0, -1.0), 2: (0.5, 0.0), 3: (1.0, 1.0)}


def test_profile_counts(spark):
    got = {r["column_name"]: r for r in cl.profile(_df(spark)).collect()}
    assert (got["k"]["n_rows"], got["k"]["n_nulls"], got["k"]["n_distinct"]) == (5, 0, 4)
    assert (got["name"]["n_nulls"], got["name"]["n_distinct"]) == (1, 4)
    assert got["price"]["min_value"] == 5.0 and got["name"]["min_value"] is None
    approx = {r["column_name"]: r["n_distinct"] for r in cl.profile(_df(spark), exact=False).collect()}
    assert approx["k"] == 4


def test_declared_steps_run_in_order(spark):
    seen = []

    def step(name):
        def fn(d):
            seen.append(name)
            return d.withColumn(name, F.lit(len(seen)))
        return fn

    out = cl.run_steps(_df(spark), [("clean", step("clean")), ("tag", step("tag"))])
    assert seen == ["clean", "tag"] and out.select("clean", "tag").first() == (1, 2)


def test_profile_of_odd_values_and_empty_tables(spark):
    import datetime as dt
    from weft.operators.cleaning import distinct_counts, profile
    rows_ = [(1, 0.0, "a", dt.date(2024, 1, 1), True), (1, -0.0, None, None, True), (2, float("nan"), "", None, False),
             (None, float("nan"), "a ", dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows_, "i long, d double, s string, t date, b boolean")
    got = {r["column_name"]: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in profile(df).collect()}
    assert got == {"i": (4, 1, 2), "d": (4, 0, 2), "s": (4, 1, 3), "t": (4, 2, 1), "b": (4, 1, 2)}
    empty = {r["column_name"]: (r["n_rows"], r["n_distinct"]) for r in profile(df.where("false")).collect()}
    assert empty == {c: (0, 0) for c in df.columns}
    wide = spark.range(3000).selectExpr("id", "id % 7 AS m", "cast(id * 37 % 1000 AS string) AS s")
    assert sorted(tuple(r) for r in distinct_counts(wide, wide.columns).collect()) == [(0, 3000), (1, 7), (2, 1000)]
    scans = profile(wide)._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    assert scans == 2


def test_sketches_of_part_files_merge(spark, tmpdir_path):
    from weft.operators.cleaning import profile_from_parts, sketch_parts
    table, kept = f"{tmpdir_path}/t", f"{tmpdir_path}/sketches"
    spark.range(20_000).selectExpr("id AS v", "cast(id % 500 AS string) AS s").repartition(4).write.parquet(table)
    parts = sketch_parts(spark.read.parquet(table), ["v", "s"], kept)
    assert parts.count() == 8
    got = {r["column_name"]: r for r in profile_from_parts(parts).collect()}
    assert (got["v"]["n_rows"], got["v"]["n_nulls"]) == (20_000, 0)
    assert abs(got["v"]["about_distinct"] - 20_000) < 600 and abs(got["s"]["about_distinct"] - 500) < 15
    assert all(abs(q - w) < 600 for q, w in zip(got["v"]["quantiles"], (5000, 10_000, 15_000))) and got["s"]["quantiles"] is None
    # a new file is sketched by itself
    spark.range(20_000, 30_000).selectExpr("id AS v", "cast(null AS string) AS s").coalesce(1).write.parquet(f"{tmpdir_path}/more")
    both = profile_from_parts(sketch_parts(spark.read.parquet(f"{tmpdir_path}/more"), ["v", "s"], kept))
    got = {r["column_name"]: r for r in both.collect()}
    assert got["s"]["n_nulls"] == 10_000 and abs(got["v"]["about_distinct"] - 30_000) < 900
