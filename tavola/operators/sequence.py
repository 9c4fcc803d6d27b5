"""Per-key sequence operators that do not put a hot key into one task.

``Window.partitionBy(key).orderBy(t)`` sends all rows of a key to one task; if one table or
customer holds a third of the rows, that task holds a third of the data.  Here a key's rows are
cut into slices of their own order (an hour of a time, ``SLICE`` of a number), so one shuffle on
(key, slice) spreads a hot key over as many tasks as it has slices:

* level 1 is a window within each (key, slice);
* level 2 carries the value in from the slices before: a window over one row for each (key, slice),
  joined back to the slice.

The slice is a function of the row, so nothing is sampled, nothing is written between, and a lost task
is made again like any other.  Both levels read the same shuffle.

``order`` holds plain ascending column expressions (they also form the ``max_by`` key of the slices); the slice
must ascend with the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice of a numeric order.
SLICE = 1024


def default_slice(df: DataFrame, at: Column) -> Column:
    """The hour of a time, the day itself of a date, a run of ``SLICE`` of a number."""
    kind = df.select(at.alias("at")).schema["at"].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast(kind), at)
    return at if kind in ("date", "string", "boolean") else F.floor(at / SLICE)


def _sliced(df: DataFrame, keys: list[str], order: list[Column], slice_by: Column | None) -> DataFrame:
    """The rows dealt by (key, slice): the only shuffle of the rows, which both levels read."""
    return df.withColumn("_sq", default_slice(df, order[0]) if slice_by is None else slice_by).repartition(*keys, "_sq")


def _joined(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe on keys and slice, as windows are."""
    names = [*keys, "_sq"]
    right = carry.select(*[F.col(c).alias(f"_r_{c}") for c in names], "_sq_in")
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return local.join(right, same, "left").drop(*[f"_r_{c}" for c in names])


def keyed_lag(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, slice_by: Column | None = None) -> DataFrame:
    """``lag(value) over (partition by keys order by order)``, computed without a per-key task."""
    sliced = _sliced(df, keys, order, slice_by)
    w = Window.partitionBy(*keys, "_sq").orderBy(*order)
    local = sliced.withColumns({name: F.lag(value).over(w), "_sq_first": F.row_number().over(w) == 1})
    summary = sliced.groupBy(*keys, "_sq").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_sq_out"))
    carry = summary.select(*keys, "_sq", F.lag("_sq_out").over(Window.partitionBy(*keys).orderBy("_sq")).alias("_sq_in"))
    out = _joined(local, carry, keys)
    carried = F.col("_sq_in").getField(value)
    return out.withColumn(name, F.when(F.col("_sq_first"), carried).otherwise(F.col(name))).drop("_sq", "_sq_first", "_sq_in")


def keyed_running_max(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, slice_by: Column | None = None) -> DataFrame:
    """``max(value) over (partition by keys order by order rows unbounded preceding .. current row)``."""
    sliced = _sliced(df, keys, order, slice_by)
    w = Window.partitionBy(*keys, "_sq").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn(name, F.max(value).over(w))
    summary = sliced.groupBy(*keys, "_sq").agg(F.max(value).alias("_sq_out"))
    before = Window.partitionBy(*keys).orderBy("_sq").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_sq", F.max("_sq_out").over(before).alias("_sq_in"))
    return _joined(local, carry, keys).withColumn(name, F.greatest(F.col(name), F.col("_sq_in"))).drop("_sq", "_sq_in")
