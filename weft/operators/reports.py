"""Report-shaped outputs: status row, analyzer union, history views, text
and JSON renderings, chart tables.

Normal form is rows; a one-row status report is assembled from scalar
subqueries (each evaluated once) rather than joins of one-row tables.
"""

from __future__ import annotations

import logging
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import scratch_path
from weft.functions.scalar import (file_name, get_or, issues_band, or_na, quality_band, seconds_between,
                                   short_date, stars)
from weft.operators.tasks import PRIORITY_LABELS
from weft.sources.appendlog import append_once
from weft.plans.isolate import failed_rows, message_of, run_isolated, spread

log = logging.getLogger(__name__)

REPORT_TITLE = "Analysis Results"


def system_status(events: DataFrame, tasks: DataFrame, agents: DataFrame,
                  tracked: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One status row. Each source table is aggregated once into a
    struct (one scan per table) and attached as a scalar subquery.
    ``tasks_completed`` counts completion events (duplicates included, as
    the reference does); ``tasks_closed`` counts tasks they actually closed.
    ``tracked`` holds the registered resources requested at least once."""
    s = F.col("status")
    done = (F.col("event_type") == "task_completed") & F.col("task_id").isNotNull()
    secs = seconds_between(F.min("ts"), F.max("ts"))
    failed = (F.col("event_type") == "task_failed") & F.col("task_id").isNotNull()
    ev = events.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"),
                             F.count_if(failed).alias("failed"), F.count("execution_time").alias("samples"),
                             F.avg("execution_time").cast("decimal(18,6)").alias("mean"),
                             F.coalesce(secs, F.lit(0.0)).alias("up"))).scalar()
    tk = tasks.agg(F.struct(F.count_if(s == "pending").alias("q"), F.count_if(s == "running").alias("a"),
                            F.count_if(s.isin("completed", "failed")).alias("c"),
                            F.count_if(s == "failed").alias("f"),
                            *[F.count_if((s == "pending") & (F.col("priority") == k)).alias(f"q{k}")
                              for k in PRIORITY_LABELS])).scalar()
    base = agents.agg(F.count(F.lit(1)).alias("registered_agents"),
                      *[F.count_if(F.col("state") == k).alias(f"{k}_agents") for k in ("idle", "busy")],
                      F.count_if(F.col("state") != "error").alias("active_agents"))
    # each struct subquery sits in one column; the measures read its fields
    base = base.withColumn("__ev", ev).withColumn("__tk", tk)
    e, t = F.col("__ev"), F.col("__tk")
    cols = [
        "registered_agents", "active_agents", "idle_agents", "busy_agents",
        e["n"].alias("events_processed"), e["done"].alias("tasks_completed"),
        e["failed"].alias("tasks_failed"), e["samples"].alias("execution_samples"),
        e["mean"].alias("mean_execution_time"),
        *[t[f"q{k}"].alias(f"queue_{v.lower()}") for k, v in PRIORITY_LABELS.items()],
        t["q"].alias("queued_tasks"), t["a"].alias("active_tasks"),
        t["c"].alias("completed_tasks"), t["f"].alias("failed_tasks"),
        tracked.select(F.count(F.lit(1))).scalar().alias("resources_tracked"),
        e["up"].alias("uptime_seconds"),
    ]
    if closed is not None:
        cols.append(closed.select(F.count(F.lit(1))).scalar().alias("tasks_closed"))
    return base.select(*cols)


def status_report(**parts: tuple[DataFrame, str | None]) -> DataFrame:
    """A11 whole: every part of the status as rows (section, item, field, value).

    Each part is a table and the column that names its items (None for a part
    of one row): the counts of :func:`system_status`, resources (A8), metrics
    (A9), agents (A12). Values are text; a missing one is null. Rows instead of
    nested maps, so a report over any number of agents stays a table."""
    out = None
    for section, (df, key) in parts.items():
        fields = [c for c in df.columns if c != key]
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
        part = df.select(F.lit(section).alias("section"), (F.col(key).cast("string") if key else F.lit("all")).alias("item"), rows.alias("f")) \
                 .select("section", "item", "f.field", "f.value")
        out = part if out is None else out.unionByName(part)
    return out


Analyzer = Callable[[DataFrame], DataFrame]


def combine_analyzers(docs: DataFrame, analyzers: Mapping[str, Analyzer],
                      key: str = "doc_id", max_errors: int = 100) -> DataFrame:
    """Run each named analyzer (``docs -> (key, detail)``, row by row)
    and union the outcomes. Analyzers run at the same time, each in one pass of
    its own, written under the shared folder. Where one fails, only the
    documents it fails for become error rows (with the whole message, or, where many
    fail, that of one of its group): see :mod:`weft.plans.isolate`, also for ``max_errors``. One whose plan can't be
    built fails for all documents. Analyzers that share measures should take a
    table of them as ``docs``, so that the texts are read once."""
    spark = docs.sparkSession
    base = scratch_path(spark, f"analyzers/{uuid.uuid4().hex[:12]}")
    lock, copies = threading.Lock(), []

    def places() -> DataFrame:
        with lock:  # the sorted copy is written once, for all analyzers that fail
            if not copies:
                copies.append(spread(docs, key, f"{base}/rows"))
            return copies[0]

    def run(numbered: tuple[int, tuple[str, Analyzer]]) -> DataFrame:
        i, (name, fn) = numbered
        path = f"{base}/{i}"
        label = F.lit(name).alias("analyzer")

        def step(rows: DataFrame) -> DataFrame:
            return fn(rows).select(F.col(key), F.col("detail").cast("string"))

        def errors(rows: DataFrame) -> DataFrame:
            return rows.select(key, label, F.lit("error").alias("status"), F.lit(None).cast("string").alias("detail"), "error")

        try:
            step(docs).schema
        except Exception as e:  # noqa: BLE001 - no plan: the analyzer fails for every document
            log.warning("analyzer %s: no plan: %s", name, e)
            return errors(docs.select(key, F.lit(message_of(e)).alias("error")))
        out = run_isolated(docs, step, path, places, max_errors, key)
        good = None
        if out.paths:
            good = spark.read.schema(out.schema).parquet(*out.paths).select(
                key, label, F.lit("ok").alias("status"), "detail", F.lit(None).cast("string").alias("error"))
        bad = failed_rows(out)
        if bad is not None:
            good = errors(bad) if good is None else good.unionByName(errors(bad))
        return good if good is not None else errors(docs.select(key, F.lit("").alias("error")).where("false"))

    if not analyzers:
        return spark.createDataFrame([], docs.select(key).schema.add("analyzer", "string").add("status", "string")
                                     .add("detail", "string").add("error", "string"))
    with ThreadPoolExecutor(len(analyzers)) as pool:
        outcomes = list(pool.map(run, enumerate(analyzers.items())))
    result = outcomes[0]
    for out in outcomes[1:]:
        result = result.unionByName(out)
    return result


def analyzers_run(combined: DataFrame, key: str = "doc_id") -> DataFrame:
    """Which analyzers produced a result for each document (sorted), from
    the outcomes: an analyzer counts where it wrote a result for the document.
    The set per document is bounded by the number of analyzers."""
    return (combined.where((F.col("status") == "ok") & F.col("detail").isNotNull()).groupBy(key)
            .agg(F.array_join(F.array_sort(F.collect_set("analyzer")), ",").alias("analyzers")))


def recent_analyses(metrics: DataFrame, k: int = 10, key: str = "doc_id",
                    path_col: str = "path", ts_col: str = "ts") -> DataFrame:
    """K2: the last ``k`` analyses (arrival = key order) with date, file name,
    the display fields and bands."""
    return (metrics.orderBy(F.col(key).desc()).limit(k)
            .select(key, short_date(F.col(ts_col)).alias("date"), file_name(F.col(path_col)).alias("file"), "quality_score", "issues_found", "rating",
                    quality_band(F.col("quality_score")).alias("score_band"),
                    issues_band(F.col("issues_found")).alias("issues_band"),
                    stars(F.col("quality_score")).alias("stars")))


def text_report(metrics: DataFrame, path_col: str = "path", key: str = "doc_id") -> DataFrame:
    """One plain-text report per file; missing values print ``N/A``."""
    recs = F.array_join(F.transform(
        F.filter(F.split(F.coalesce(F.col("recommendations"), F.lit("")), "; "), lambda r: r != ""),
        lambda r: F.concat(F.lit("- "), r)), "\n")
    body = F.format_string(
        REPORT_TITLE + "\n" + "=" * len(REPORT_TITLE) + "\nFile: %s\nQuality Score: %s/10\n"
        "Rating: %s\n\nMetrics:\n- Lines of Code: %s\n- Functions: %s\n- Classes: %s\n"
        "- Complexity: %s\n- Security Issues: %s\n\nRecommendations:\n%s",
        or_na(F.col(path_col)), or_na(F.col("quality_score")), or_na(F.col("rating")),
        or_na(F.col("lines_of_code")), or_na(F.col("function_count")),
        or_na(F.col("class_count")), or_na(F.col("complexity")),
        or_na(F.col("security_issues")), recs)
    return metrics.select(key, body.alias("report"))


def json_results(metrics: DataFrame, path_col: str = "path", key: str = "doc_id") -> DataFrame:
    """One JSON document per file (nested ``metrics`` object)."""
    m = F.struct("lines_of_code", "function_count", "class_count", "complexity",
                 "security_issues")
    return metrics.select(key, F.to_json(F.struct(
        F.col(path_col).alias("file_path"), F.col("quality_score").cast("double").alias("quality_score"),
        "rating", "issues_found", m.alias("metrics"))).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows as JSON lines; timestamps are written as ISO text."""
    df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def write_text(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """S6 sink: one text record per row."""
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


def append_history(results: DataFrame, path: str, ts_col: str = "ts", token: str | None = None) -> None:
    """Append finished results, partitioned by date. With a ``token`` of the
    batch, a repeated or broken append adds its rows once
    (:mod:`weft.sources.appendlog`, read by ``read_appends``)."""
    rows = results.withColumn("date", F.to_date(ts_col))
    if token is not None:
        append_once(rows, path, token, ["date"])
    else:
        rows.write.mode("append").partitionBy("date").parquet(path)


def complexity_histogram(metrics: DataFrame, width: int = 10) -> DataFrame:
    """Documents per complexity bucket ``[width*i, width*(i+1))``, for the
    buckets that occur."""
    b = F.floor(F.col("complexity") / width).cast("bigint")
    return (metrics.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"))
            .withColumn("lower_bound", F.col("bucket") * width))


def quality_kpis(metrics: DataFrame) -> DataFrame:
    """One row of headline quality figures."""
    return metrics.agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("quality_score").cast("decimal(18,6)").alias("average_score"),
        F.count_if(F.col("issues_found") == 0).alias("clean_documents"),
        F.sum("security_issues").cast("bigint").alias("security_issues"))


def event_trend(events: DataFrame, unit: str = "day") -> DataFrame:
    """Events per time unit and type."""
    period = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return (events.groupBy(period.alias("period"), "event_type")
            .agg(F.count(F.lit(1)).alias("n")))


def exclude_expired(df: DataFrame, as_of, days: int, ts_col: str = "ts",
                    partition_col: str | None = None) -> DataFrame:
    """Keep rows newer than ``as_of - days``. On a table partitioned by
    date, pass ``partition_col`` and the same cut-off is also stated on the
    partition column, so whole expired partitions are skipped at listing
    time (``PartitionFilters``)."""
    cut = as_of - F.make_interval(days=F.lit(days))
    out = df.where(F.col(ts_col) >= cut)
    if partition_col:
        out = out.where(F.col(partition_col) >= F.to_date(cut))
    return out


def append_memory(episodes: DataFrame, path: str, token: str | None = None) -> None:
    """Append episodes, partitioned by their context type; ``token`` as in
    :func:`append_history`."""
    rows = episodes.withColumn("type", get_or(F.col("context"), "type", "unknown"))
    if token is not None:
        append_once(rows, path, token, ["type"])
    else:
        rows.write.mode("append").partitionBy("type").parquet(path)


def episodes_of_type(episodes: DataFrame, kind: str) -> DataFrame:
    """S10 retrieval: episodes whose context type is ``kind`` (missing type
    reads as ``unknown``)."""
    return episodes.where(get_or(F.col("context"), "type", "unknown") == kind)


def memory_episodes(turns: DataFrame) -> DataFrame:
    """Episodes ``(content, context)`` with a context map of type and
    conversation; ``context['type']`` filters by kind."""
    return turns.select(
        "conv_id", "turn", F.col("text").alias("content"),
        F.create_map(F.lit("type"), F.col("role"),
                     F.lit("conversation"), F.col("conv_id").cast("string")).alias("context"))
