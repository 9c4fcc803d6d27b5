"""tavola: restaurant / point-of-sale analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    reading the parquet inputs and mapping them onto the restaurant domain
functions  scalar rules (discount, service charge, tiers, money formatting) as Column expressions
operators  reports, joins, rankings, pair mining, set-based jobs and data-quality checks
plans      the named query catalogue and the DuckDB oracle SQL for each query
streaming  Structured Streaming versions of the change-driven rules
"""

import sys as _sys

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]

# Python code that runs on executors (pandas UDF bodies, stateful processors) is
# shipped with the task by value, so executors need no copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value registration
    pass
