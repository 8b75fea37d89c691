"""Named queries over a testdata directory and their DuckDB oracles.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is
the equivalent SQL over the raw tables (DuckDB dialect). Both sides alias
every computed column to the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.sources.adapters import Model, with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(model) -> DataFrame`` builder under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Model(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from weft.plans import (q_events, q_tasks, q_agents, q_metrics, q_resources,  # noqa: F401
                            q_corpus, q_source, q_cleaning, q_similarity, q_reports, q_streaming, q_io, q_payload)


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


__all__ = ["query", "with_ctes", "all_queries", "all_oracles", "QUERIES", "ORACLE"]
