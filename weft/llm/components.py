"""Connected components by rounds of contraction, on DataFrames only.

Each round every node points to the smallest node among itself and its
neighbours; the pointers are followed a few steps; then each edge is replaced
by the edge between its ends' targets, and loops and repeats go. A node with
very many neighbours costs one row of a pre-aggregated minimum. Every round is
written to the shared folder, and the root of a component is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import scratch


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); the root is the
    smallest node reachable. Nodes without an edge aren't listed."""
    e = scratch.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .where("a <> b").distinct(), f"{folder}/e0")
    spark, known, i = edges.sparkSession, None, 0
    while not e.isEmpty():
        i += 1
        point = e.select(F.col("b").alias("node"), F.col("a").alias("to")).union(e.select(F.col("a").alias("node"), F.col("b").alias("to"))) \
                 .groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        point = scratch.stored(point, f"{folder}/p{i}a")
        for step in "bc":  # follow twice: pointers of length up to 4
            on = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(on, "to").select("node", F.col("next").alias("to"))
        point = scratch.stored(point, f"{folder}/p{i}")
        if known is None:
            known = point.select("node", F.col("to").alias("root"))
        else:
            far = point.select(F.col("node").alias("root"), "to")
            known = known.join(far, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        known = scratch.stored(known, f"{folder}/k{i}")
        pa, pb = point.toDF("a", "ra"), point.toDF("b", "rb")
        e = e.join(pa, "a").join(pb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        e = scratch.stored(e, f"{folder}/e{i}")
    return known if known is not None else spark.createDataFrame([], "node long, root long")
