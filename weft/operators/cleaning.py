"""Data cleaning, normalization, validation and profiling.

Each step is a ``DataFrame -> DataFrame`` function so a declared list of
steps composes with ``DataFrame.transform``. Whole-table statistics
(min/max/mean/stddev) are scalar subqueries, which Spark evaluates once and
merges when they read the same source, instead of joining a one-row table
back onto every row.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def clean(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Trim string columns, drop rows missing a required column, and keep
    one row per key — the smallest row by the remaining columns, so the
    choice is deterministic (``min`` over a struct, a partial aggregate)."""
    trimmed = df.select(*[F.trim(F.col(f.name)).alias(f.name)
                          if isinstance(f.dataType, T.StringType) else F.col(f.name)
                          for f in df.schema.fields])
    if required:
        trimmed = trimmed.na.drop(subset=list(required))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return trimmed.select(*keys).distinct()
    return (trimmed.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r"))
            .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]))


def normalize(df: DataFrame, col: str) -> DataFrame:
    """Add ``<col>_minmax`` and ``<col>_z`` (sample stddev), as
    ``decimal(18,6)``. The four statistics come from one struct-valued scalar
    subquery (one scan)."""
    x = F.col(col).cast("double")
    st = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mu"),
                         F.stddev_samp(x).alias("sd"))).scalar()
    # the subquery sits in one column; the four uses read its fields
    s = F.col("__st")
    return (df.withColumn("__st", st)
            .select(*df.columns,
                    F.try_divide(x - s["lo"], s["hi"] - s["lo"]).cast("decimal(18,6)").alias(f"{col}_minmax"),
                    F.try_divide(x - s["mu"], s["sd"]).cast("decimal(18,6)").alias(f"{col}_z")))


def validate(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """D3: one row per (row key, failed rule). A rule is a boolean column
    that is true for a valid row; null counts as a failure."""
    fails = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                               for name, cond in rules.items()]), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(fails).alias("rule"))


def valid_flag(rules: Mapping[str, Column]) -> Column:
    out = F.lit(True)
    for cond in rules.values():
        out = out & F.coalesce(cond, F.lit(False))
    return out


def run_steps(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]
              ) -> DataFrame:
    """Apply a declared, ordered list of named steps."""
    for _, fn in steps:
        df = df.transform(fn)
    return df


def run_summary(source: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]],
                valid: Column) -> DataFrame:
    """Run the steps and report the records that went in, those
    kept, the valid ones among them and their share, and the steps that ran.
    The input count is a scalar subquery over the source alone."""
    return run_steps(source, steps).agg(
        F.count(F.lit(1)).alias("records_kept"),
        F.count_if(valid).alias("valid_records"),
        F.try_divide(F.count_if(valid).cast("double"), F.count(F.lit(1)).cast("double"))
        .cast("decimal(18,6)").alias("valid_share"),
        F.lit(", ".join(name for name, _ in steps)).alias("steps_applied"),
    ).select(source.agg(F.count(F.lit(1))).scalar().alias("records_processed"), "*")


def _extremes(c: str, number: bool) -> list[Column]:
    lo, hi = F.col(f"{c}__min"), F.col(f"{c}__max")
    no, none = F.lit(None).cast("double"), F.lit(None).cast("string")
    return [(lo if number else no).alias("min_value"), (hi if number else no).alias("max_value"),
            (none if number else lo).alias("min_text"), (none if number else hi).alias("max_text")]


def _value_bits(c: str) -> Column:
    """A column's value as 128 hash bits, the same for equal values only."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column number, distinct values): one grouped pass over (column, value), for
    any number of columns. Values meet as 128-bit hashes, partly aggregated before
    the shuffle, so a column of few values sends few rows."""
    cells = F.array(*[F.when(F.col(c).isNotNull(), _value_bits(c)) for c in columns])
    each = df.select(F.posexplode(cells).alias("at", "v")).where(F.col("v").isNotNull()).select("at", "v.a", "v.b")
    return each.distinct().groupBy("at").agg(F.count(F.lit(1)).alias("n_distinct"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
            ) -> DataFrame:
    """Per column rows, nulls, distinct values and min/max: numbers in
    ``min_value`` / ``max_value``, other types as text in ``min_text`` / ``max_text``.

    Two scans for any number of columns: one aggregate over all columns,
    unpivoted by exploding an array of per-column structs, and one grouped pass
    for the exact distinct counts (:func:`distinct_counts`); ``exact=False`` uses
    HyperLogLog++ (``approx_count_distinct``) inline and needs the first alone."""
    cols = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"{c}__nn"))
        if not exact:
            aggs.append(F.approx_count_distinct(F.col(c)).alias(f"{c}__nd"))
        if isinstance(types[c], NUMERIC):
            aggs.append(F.min(F.col(c)).cast("double").alias(f"{c}__min"))
            aggs.append(F.max(F.col(c)).cast("double").alias(f"{c}__max"))
        else:
            aggs.append(F.min(F.col(c)).cast("string").alias(f"{c}__min"))
            aggs.append(F.max(F.col(c)).cast("string").alias(f"{c}__max"))
    one = df.agg(*aggs)
    if exact:
        found = distinct_counts(df, cols).agg(F.map_from_entries(F.collect_list(F.struct("at", "n_distinct")))).scalar()  # one entry per column
        one = one.withColumn("__nd", found).select("*", *[
            F.coalesce(F.try_element_at("__nd", F.lit(i)), F.lit(0)).cast("bigint").alias(f"{c}__nd") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.col("__rows").alias("n_rows"),
                              (F.col("__rows") - F.col(f"{c}__nn")).alias("n_nulls"),
                              F.col(f"{c}__nd").alias("n_distinct"),
                              *_extremes(c, isinstance(types[c], NUMERIC))) for c in cols])
    return one.select(F.explode(rows).alias("p")).select("p.*")


QUANTILES = (0.25, 0.5, 0.75)


def sketch_parts(df: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    """A16, kept per part file: one row per (file, column) with counts and, as mergeable
    sketches, distinct values (HyperLogLog) and for numbers quantiles (KLL). New
    files are sketched by themselves and their rows appended; see :func:`profile_from_parts`."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(F.col("_metadata.file_path").alias("part"), *columns)

    def column(c: str) -> DataFrame:
        number = isinstance(types[c], NUMERIC)
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_values"),
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(14)).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(F.col(c).cast("double")) if number else F.lit(None).cast("binary")).alias("quantile_sketch"))

    parts = rows.groupBy("part").agg(F.array(*[column(c) for c in columns]).alias("l"))
    parts.select("part", F.explode("l").alias("p")).select("part", "p.*").write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def profile_from_parts(parts: DataFrame) -> DataFrame:
    """The profile of all sketched files: (column_name, n_rows, n_nulls, about_distinct, quantiles)."""
    merged = parts.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_rows") - F.sum("n_values")).alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("about_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("q"), (F.sum(F.when(F.col("quantile_sketch").isNotNull(), F.col("n_values"))) > 0).alias("numbers"))
    shown = F.kll_sketch_get_quantile_double("q", F.array(*[F.lit(x) for x in QUANTILES]))
    return merged.select("column_name", "n_rows", "n_nulls", "about_distinct", F.when(F.col("numbers"), shown).alias("quantiles"))
