"""Summarise the executed physical plan of catalog queries.

Usage: python tools/plan_summary.py [sf_dir] [name ...]
For each query: exchanges (shuffles), reused exchanges, join strategies,
aggregate kinds, window-group limits and the columns read from each scan.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weft.plans.catalog import all_queries  # noqa: E402
from weft.session import local_session  # noqa: E402

KINDS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
         "WindowGroupLimit", "Window", "Generate", "TakeOrderedAndProject", "MapInPandas",
         "TransformWithStateInPySpark", "Expand"]


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def summarise(plan: str) -> str:
    lines = plan.splitlines()
    c = Counter()
    for ln in lines:
        s = ln.strip().lstrip(":+- ")
        if s.startswith("Exchange "):
            c["shuffle" if "SinglePartition" not in s else "single-partition exchange"] += 1
        if s.startswith("ReusedExchange"):
            c["reused exchange"] += 1
        for k in KINDS:
            if re.match(rf"(\*\(\d+\) )?{k}\b", s):
                c[k] += 1
    scans = sorted(set(re.findall(r"Location: \w+\(\d+ paths\)\[[^\]]*/(\w+)\.parquet\][^\n]*?ReadSchema: (struct<[^>]*>)", plan)))
    parts = [f"{k} x{v}" for k, v in sorted(c.items())]
    reads = "; ".join(f"{t}: {s[7:-1]}" for t, s in scans)
    return ", ".join(parts) + (f" | reads {reads}" if reads else "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in all_queries().items():
        if only and name not in only:
            continue
        if name.startswith("stream_") or name in ("tumbling_event_counts", "window_alerts"):  # noqa: E501
            print(f"| {name} | streaming run (plan per micro-batch) |")
            continue
        print(f"| {name} | {summarise(final_plan(fn(spark, sf)))} |")


if __name__ == "__main__":
    main()
