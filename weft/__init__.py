"""weft: work-coordination analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    table loading, model adapters, corpus readers and sinks
functions  column-level helpers (scalar functions, fixed rule sets)
operators  DataFrame -> DataFrame operators grouped by domain
plans      reusable plan shapes (distributed ranking, ordered folds) and the
           named query catalog used by ``__spark_entry__``
streaming  Structured Streaming twins of the stateful operators
"""

import sys as _sys

# Functions and stateful processors from this package run in Spark's Python
# workers (mapInPandas, transformWithStateInPandas, foreachBatch). Pickling
# them by value ships their code with the task, so executors need no copy of
# the package on their path (no --py-files, any working directory).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to --py-files
    pass

__all__ = ["session"]
