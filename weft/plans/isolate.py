"""Row-level isolation of a failing per-row computation.

A Spark job fails as a whole when one row raises. :func:`run_isolated` first
runs the computation over all rows, in one pass. Only if that fails, the rows
are written once, sorted by a hash of their key. Then one pass over them finds
the keys that raise (:func:`sieve`), and one more runs the computation on all
others: two passes for any number of failing keys.

A sieve reaches what Spark's expressions raise. Where it does not (a Python
function, a computation that fails elsewhere in its plan), the run is repeated on
ever smaller hash ranges: a range that passes stands, a range that fails is cut
into ``PARTS`` and each part is run again, until a failing range holds one key.
The file statistics of the sorted copy let each run read its own range only, so
a level costs at most one reading of the ranges still in doubt: with b failing
keys among n, about log_16(n) levels over ever fewer rows, but up to ``PARTS``
runs for each failing key and level.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

PARTS = 16
RUNS_AT_ONCE = 8
OWN_MESSAGES = 64   # failing keys that are run one by one for their messages
PLACE = "__place"
Step = Callable[[DataFrame], DataFrame]


@dataclass
class Outcome:
    """What came of one computation: paths of the written results, and the ranges
    ``(low, high, message)`` of ``places`` whose rows have none, or a table of ``many``."""
    paths: list[str] = field(default_factory=list)
    failed: list[tuple[int, int, str]] = field(default_factory=list)
    many: DataFrame | None = None   # (place, error) of further keys that have none
    schema: object = None
    places: DataFrame | None = None
    gave_up: bool = False


def message_of(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def spread(rows: DataFrame, key: str, path: str) -> DataFrame:
    """A copy of ``rows`` sorted by a hash of the key, so that a hash range is a range of its files."""
    placed = rows.withColumn(PLACE, F.xxhash64(F.col(key)))
    n = max(placed.sparkSession.sparkContext.defaultParallelism, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartitionByRange(n, PLACE).sortWithinPartitions(PLACE).write.parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def _within(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.col(PLACE).between(low, high))


def _parts(rows: DataFrame, low: int, high: int) -> list[tuple[int, int]]:
    """The range cut into ``PARTS`` of equal width, each shrunk to the keys it holds."""
    width = (high - low) // PARTS + 1
    number = F.floor((F.col(PLACE).cast("decimal(20,0)") - low) / F.lit(width).cast("decimal(20,0)"))
    found = _within(rows, low, high).groupBy(number.alias("part")).agg(F.min(PLACE).alias("low"), F.max(PLACE).alias("high")).collect()
    return sorted((r["low"], r["high"]) for r in found)


def sieve(copy: DataFrame, step: Step, key: str, value: str, path: str) -> DataFrame:
    """The places of the keys whose ``value`` raises, written: one pass over all rows.
    ``try_to_binary`` is null where its argument raises; it is given the value's
    length, or 0, so nothing else makes it null. Raises itself where the failure
    lies outside the value's expression."""
    out = step(copy.drop(PLACE))
    tried = F.try_to_binary(F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)).cast("string"), F.lit("utf-8"))
    out.select(F.xxhash64(F.col(key)).alias(PLACE), tried.isNull().alias("__raised")).where("__raised").select(PLACE).distinct().write.parquet(path)
    return copy.sparkSession.read.schema(f"{PLACE} long").parquet(path)


def _sieved(copy: DataFrame, step: Step, key: str, value: str, path: str, attempt, done: Outcome) -> bool:
    """Run ``step`` on the keys that the sieve lets pass and fetch messages for the others;
    False if the sieve does not tell them apart. Up to ``OWN_MESSAGES`` failing
    keys are run one by one, more in ``PARTS`` groups, of which each key takes the message."""
    try:
        bad = sieve(copy, step, key, value, f"{path}/sieve")
        number = bad.count()
        if not number:
            return False
        schema = attempt(copy.join(bad, PLACE, "left_anti").drop(PLACE), "passed")
    except Exception as e:  # noqa: BLE001 - not the value alone fails
        log.warning("no sieve: %s", message_of(e))
        return False
    few = number <= OWN_MESSAGES
    group = F.pmod(F.xxhash64(PLACE, F.lit(PARTS)), F.lit(PARTS))
    names = [r[0] for r in (bad if few else bad.select(group).distinct()).collect()]

    def message(numbered: tuple[int, int]) -> str | None:
        i, name = numbered
        part = _within(copy, name, name) if few else copy.join(bad.where(group == name), PLACE, "left_semi")
        try:
            attempt(part.drop(PLACE), f"raised-{i}")
            return None
        except Exception as e:  # noqa: BLE001
            return message_of(e)

    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
        told = list(zip(names, pool.map(message, enumerate(names))))
    done.schema = schema
    done.paths += [f"{path}/passed"] + [f"{path}/raised-{i}" for i, (_, error) in enumerate(told) if error is None]
    told = [(name, error) for name, error in told if error is not None]
    if few:
        done.failed = [(name, name, error) for name, error in told]
    elif told:
        errors = copy.sparkSession.createDataFrame(told, "__group long, error string")
        done.many = bad.withColumn("__group", group).join(F.broadcast(errors), "__group").drop("__group")
    return True


def run_isolated(rows: DataFrame, step: Step, path: str, places: Callable[[], DataFrame], max_errors: int,
                 key: str = "doc_id", value: str = "detail") -> Outcome:
    """Run ``step`` (row by row: a row's ``value`` may not depend on other rows) and write
    its result under ``path``; isolate what fails.

    ``places`` gives the sorted copy of the rows and is called only after a failure.
    Where the sieve can't tell, an analyzer that fails for more than ``max_errors``
    keys is given up: the rows that have not passed by then all count as failed."""
    def attempt(part: DataFrame, name: str):
        out = step(part)
        out.write.parquet(f"{path}/{name}")
        return out.schema

    done = Outcome()
    try:
        done.schema = attempt(rows, "all")
        done.paths.append(f"{path}/all")
        return done
    except Exception as e:  # noqa: BLE001 - a failing analyzer must not stop the others
        first = message_of(e)
    done.places = copy = places()
    everything = copy.agg(F.min(PLACE), F.max(PLACE)).first()
    if everything[0] is None:
        return done
    try:  # what fails without any row fails for all of them
        done.schema = attempt(copy.where("false").drop(PLACE), "none")
    except Exception as e:  # noqa: BLE001
        log.warning("fails without rows: %s", message_of(e))
        done.failed.append((*everything, message_of(e)))
        return done

    if _sieved(copy, step, key, value, path, attempt, done):
        return done

    def probe(numbered: tuple[int, tuple[int, int]]) -> tuple[int, int, str | None, str]:
        i, (low, high) = numbered
        name = f"{level}-{i}"
        try:
            attempt(_within(copy, low, high).drop(PLACE), name)
            return low, high, None, name
        except Exception as e:  # noqa: BLE001
            return low, high, message_of(e), name

    doubt, level = [(*everything, first)], 0
    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
        while doubt:
            done.failed += [r for r in doubt if r[0] == r[1]]
            wide = [r for r in doubt if r[0] < r[1]]
            if len(done.failed) + len(wide) > max_errors:
                done.failed += wide
                done.gave_up = bool(wide)
                break
            level += 1
            parts = [p for ps in pool.map(lambda r: _parts(copy, r[0], r[1]), wide) for p in ps]
            doubt, at = [], 0
            while at < len(parts) and len(done.failed) + len(doubt) <= max_errors:
                for low, high, error, name in pool.map(probe, enumerate(parts[at:at + RUNS_AT_ONCE], at)):
                    if error is None:
                        done.paths.append(f"{path}/{name}")
                    else:
                        doubt.append((low, high, error))
                at += RUNS_AT_ONCE
            if at < len(parts):  # given up: what was not run by now counts as failed, with the last error
                done.failed += doubt + [(low, high, doubt[-1][2]) for low, high in parts[at:]]
                done.gave_up = True
                break
    log.warning("isolated %d failing ranges in %d levels", len(done.failed), level)
    return done


def failed_rows(outcome: Outcome) -> DataFrame | None:
    """The rows without a result, with the ``error`` of their range."""
    if outcome.many is not None:
        return outcome.places.join(outcome.many, PLACE).drop(PLACE)
    if not outcome.failed:
        return None
    copy = outcome.places
    spark = copy.sparkSession
    ranges = spark.createDataFrame(outcome.failed, "low long, high long, error string")
    single = copy.join(ranges.where("low = high").withColumnRenamed("low", PLACE).drop("high"), PLACE)
    wide = [r for r in outcome.failed if r[0] < r[1]]
    for low, high, error in wide:
        single = single.unionByName(_within(copy, low, high).withColumn("error", F.lit(error)))
    return single.drop(PLACE)
