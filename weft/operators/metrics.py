"""Metric-sample operators: bounded histories and their summaries.

``agent_metrics(seq, agent_id, metric, ts, value)`` and
``system_metrics(seq, metric, ts, value)``. Recency is by ``seq``.
Averages are returned as ``decimal(18,6)`` so every engine prints the same
digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.appendlog import append_once
from weft.functions.scalar import seconds_between

AGENT_WINDOW = 10      # samples per (agent, metric) summarised
HISTORY_SIZE = 1000    # samples kept per series / for the system series


def bounded_history(samples: DataFrame, keys, n: int = HISTORY_SIZE) -> DataFrame:
    """The last ``n`` samples per key. ``row_number() <= n`` is planned as
    a WindowGroupLimit, applied partially before the shuffle, so a hot key
    ships at most ``n`` rows from each map task."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return (samples.withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") <= n).drop("__rn"))


def _summary(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max_by("value", "seq").alias("current"),
        F.avg("value").cast("decimal(18,6)").alias("average"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n"))


def agent_metric_stats(agent_metrics: DataFrame, n: int = AGENT_WINDOW) -> DataFrame:
    """Current / average / min / max over the last ``n`` samples of each
    (agent, metric). Agent and metric are separate columns, so agent ``a``
    never matches ``a.b`` (the reference's prefix lookup does)."""
    return _summary(bounded_history(agent_metrics, ["agent_id", "metric"], n),
                    ["agent_id", "metric"])


def system_metric_stats(system_metrics: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The system series is one history of ``n`` rows across all
    metrics; summarise the last ``n`` rows per metric (TakeOrderedAndProject
    then a tiny aggregate)."""
    last = system_metrics.orderBy(F.col("seq").desc()).limit(n)
    return _summary(last, ["metric"])


def uptime_seconds(events: DataFrame, as_of=None) -> DataFrame:
    """A10: seconds from the first event to ``as_of`` (default: last event);
    0 when there are no events."""
    end = F.max("ts") if as_of is None else F.lit(as_of)
    secs = seconds_between(F.min("ts"), end)
    return events.agg(F.coalesce(secs, F.lit(0.0)).alias("uptime_seconds"))


def append_samples(samples: DataFrame, path: str, partition_by=("metric",), token: str | None = None) -> None:
    """Append samples to a parquet table partitioned by metric; with a
    ``token`` of the batch they are added once (:mod:`weft.sources.appendlog`)."""
    if token is not None:
        append_once(samples, path, token, partition_by)
    else:
        samples.write.mode("append").partitionBy(*partition_by).parquet(path)
