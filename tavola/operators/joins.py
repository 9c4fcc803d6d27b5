"""Join helpers.

``sized_broadcast`` is the only way library code asks for a broadcast of a
table that could grow: it measures the rows and the bytes of the side (at most
``max_rows + 1`` rows are looked at, each task stops early) and adds the hint only when
both fit, otherwise the join is left to the planner (sort-merge, with adaptive
execution's runtime re-planning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast when it has at most this many rows and bytes.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(8) for c in df.columns), F.lit(8))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
