"""W7 for one hot resource: its log cut into chunks that run at the same time.

A grant depends on the holders left by the whole log before it, but mostly on
its last stretch: two runs that begin with different holders become equal as
soon as they hold the same. So each chunk guesses its first holders by a run
over the ``WARM`` events before it, from no holders at all, and then runs its own
events. Where a chunk's guess equals the end of the chunk before it, all the way
from the first chunk, the guess was right. The others run again from the end
before them; what still differs after ``ROUNDS`` rounds (holders that never
release keep the runs apart) goes through one task in order, from the
resource's first wrong chunk on. Every result is exact; only the time differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.resources import OUT_SCHEMA, OUTCOMES, admit_run
from weft.plans.ordered import rank_within
from weft.sources.tabular import written

CHUNK = 1 << 16
WARM = 1 << 13
ROUNDS = 4
ENDS = "resource_id long, chunk long, first array<long>, last array<long>"


def _run(pdf: pd.DataFrame, holders: list) -> tuple[np.ndarray, np.ndarray, list]:
    limit = pdf["max_concurrent"].iloc[0] if len(pdf) else None
    return admit_run(pdf["agent_id"].to_numpy(), (pdf["action"] == "request").to_numpy(),
                     None if limit is None or pd.isna(limit) else int(limit), holders)


def _chunked(rows: DataFrame, chunk: int, warm: int) -> DataFrame:
    """Rows with their chunk; the last ``warm`` of each chunk once more, for the next."""
    at = F.floor((F.col("pos") - 1) / chunk)
    late = (F.col("pos") - 1) % chunk >= chunk - warm
    both = F.when(late, F.array(at, at + 1)).otherwise(F.array(at))
    return rows.select("*", at.alias("own"), F.explode(both).alias("chunk"))


def _guess(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    before, own = pdf[pdf["own"] != pdf["chunk"]], pdf[pdf["own"] == pdf["chunk"]]
    if not len(own):  # past the resource's last chunk
        return pd.DataFrame([], columns=["resource_id", "chunk", "first", "last"])
    first = sorted(_run(before, [])[2]) if len(before) else []
    last = sorted(_run(own, list(first))[2])
    return pd.DataFrame({"resource_id": [own["resource_id"].iloc[0]], "chunk": [own["chunk"].iloc[0]], "first": [first], "last": [last]})


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    first = list(pdf["first"].iloc[0])
    return pd.DataFrame({"resource_id": [pdf["resource_id"].iloc[0]], "chunk": [pdf["own"].iloc[0]], "first": [first],
                         "last": [sorted(_run(pdf, list(first))[2])]})


def _outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    code, after, _ = _run(pdf, list(pdf["first"].iloc[0]))
    return pd.DataFrame({"seq": pdf["seq"].to_numpy(), "resource_id": pdf["resource_id"].to_numpy(), "agent_id": pdf["agent_id"].to_numpy(),
                         "action": pdf["action"].to_numpy(), "outcome": OUTCOMES[code], "holders_after": after})


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ends of the chunks of rows sorted by (resource_id, pos), one after the other."""
    at, first, holders = None, [], []
    for pdf in batches:
        out = []
        for (res, chunk), part in pdf.groupby(["resource_id", "own"], sort=False):
            if at is None or at[0] != res:
                if at:
                    out.append((*at, first, sorted(holders)))
                at, first, holders = (res, chunk), list(part["first"].iloc[0]), list(part["first"].iloc[0])
            elif at[1] != chunk:
                out.append((*at, first, sorted(holders)))
                at, first = (res, chunk), sorted(holders)
            holders = _run(part, holders)[2]
        yield pd.DataFrame(out, columns=["resource_id", "chunk", "first", "last"])
    if at:
        yield pd.DataFrame([(*at, first, sorted(holders))], columns=["resource_id", "chunk", "first", "last"])


def hot_admission(log: DataFrame, resources: DataFrame, chunk: int = CHUNK, warm: int = WARM, rounds: int = ROUNDS
                  ) -> tuple[DataFrame, DataFrame]:
    """(outcomes as of ``resource_admission``, chunks) of a log with hot resources.

    ``chunks`` tells per chunk in which round it was settled (0: the guess was right;
    -1: in order). ``seq`` is unique within a resource."""
    rows = log.select("seq", "resource_id", "agent_id", "action").join(resources.select("resource_id", "max_concurrent"), "resource_id", "left")
    rows = written(rank_within(rows, ["resource_id"], "seq", name="pos", materialize=True), "admission-rows")
    own = rows.withColumn("own", F.floor((F.col("pos") - 1) / chunk))
    ends = _chunked(rows, chunk, warm).groupBy("resource_id", "chunk").applyInPandas(_guess, ENDS)
    ends = written(ends.withColumn("round", F.lit(0)), "admission-ends")
    before = F.coalesce(F.lag("last").over(Window.partitionBy("resource_id").orderBy("chunk")), F.array().cast("array<long>"))
    for i in range(1, rounds + 2):
        checked = ends.withColumn("before", before)
        wrong = written(checked.where(F.col("first") != F.col("before")).select("resource_id", "chunk", "before"), "admission-wrong")
        if wrong.isEmpty():
            break
        if i <= rounds:
            todo = wrong.select("resource_id", F.col("chunk").alias("own"), F.col("before").alias("first"))
            new = own.join(todo, ["resource_id", "own"]).groupBy("resource_id", "own").applyInPandas(_again, ENDS)
        else:
            begin = wrong.groupBy("resource_id").agg(F.min("chunk").alias("begin"), F.min_by("before", "chunk").alias("first"))
            rest = own.join(begin, "resource_id").where("own >= begin").select("resource_id", "own", "pos", "agent_id", "action", "max_concurrent", "first")
            new = rest.repartition("resource_id").sortWithinPartitions("resource_id", "pos").mapInPandas(_in_order, ENDS)
        new = written(new.withColumn("round", F.lit(i if i <= rounds else -1)), "admission-again")
        ends = written(ends.join(new.select("resource_id", "chunk"), ["resource_id", "chunk"], "left_anti").unionByName(new), "admission-ends")
    done = own.join(ends.select("resource_id", F.col("chunk").alias("own"), "first"), ["resource_id", "own"])
    return done.groupBy("resource_id", "own").applyInPandas(_outcomes, OUT_SCHEMA), ends.select("resource_id", "chunk", "round")
