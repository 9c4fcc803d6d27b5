"""Distributed global ranking.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
``global_rank`` keeps the work spread out:

1. range-partition rows with a total order (for ranks with ties: the histogram
   of distinct key values) so partitions are ordered and balanced,
2. number / sum inside each partition with a partitioned window,
3. add the totals of all earlier partitions (a prefix sum over one row per
   partition, i.e. at most ``spark.sql.shuffle.partitions`` rows),
4. for rank / dense_rank, join the per-value rank back to the rows.

The range-partitioned frame goes through ``checkpoint(eager=False)``: the
per-partition counts and the local ranks then read one RDD whose range bounds
were sampled once, so they agree on the partitioning (also when lost tasks are
re-run), and the reliable checkpoint in ``spark.checkpoint.dir`` cuts the
lineage after the first job.  (Eager checkpoints were measured slower.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.session import ensure_checkpoint_dir


def _prefix_positions(df: DataFrame, order: list[Column], weight: Column, parts: int) -> DataFrame:
    """Per row: ``_gr_before`` = Σ weight of all rows before it, ``_gr_pos`` = its 1-based position.

    ``order`` must be a total order of ``df`` (no two rows compare equal), so the
    range partitioning can cut anywhere and stays balanced.
    """
    ranged = (
        df.withColumn("_gr_w", weight)
        .repartitionByRange(parts, *order)
        .withColumn("_gr_part", F.spark_partition_id())
        .checkpoint(eager=False)
    )
    local_w = Window.partitionBy("_gr_part").orderBy(*order)
    local = ranged.withColumn(
        "_gr_lsum", F.coalesce(F.sum("_gr_w").over(local_w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_gr_lpos", F.row_number().over(local_w))
    sizes = ranged.groupBy("_gr_part").agg(F.sum("_gr_w").alias("_gr_tot"), F.count(F.lit(1)).alias("_gr_cnt"))
    # one row per partition: the prefix sums are tiny and bounded by `parts`
    earlier = Window.orderBy("_gr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_gr_part",
        F.coalesce(F.sum("_gr_tot").over(earlier), F.lit(0)).alias("_gr_off"),
        F.coalesce(F.sum("_gr_cnt").over(earlier), F.lit(0)).alias("_gr_coff"),
    )
    out = local.join(F.broadcast(offsets), "_gr_part")
    return out.select(
        *[c for c in df.columns],
        (F.col("_gr_off") + F.col("_gr_lsum")).alias("_gr_before"),
        (F.col("_gr_coff") + F.col("_gr_lpos")).alias("_gr_pos"),
    )


def global_rank(
    df: DataFrame,
    order: list[Column],
    name: str = "rank",
    method: str = "rank",
    num_partitions: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Append ``name`` = rank / dense_rank / row_number of each row over ``order``.

    ``row_number`` needs ``order`` to be a total order (end with a unique key).
    ``rank`` / ``dense_rank`` need ``keys``, the columns ``order`` sorts by: ties
    are handled on the histogram of distinct key values (one row per value, a
    partial aggregate), so a value shared by a third of the rows never lands in
    one task; the ranks are joined back on the key values.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if method == "row_number":
        pos = _prefix_positions(df, order, F.lit(1), parts)
        return pos.withColumn(name, F.col("_gr_pos").cast("long")).drop("_gr_before", "_gr_pos")
    if method not in ("rank", "dense_rank"):
        raise ValueError(method)
    if not keys:
        raise ValueError("rank / dense_rank need the key columns of the ordering")
    # the rows are read twice (histogram, join back): one shared, checkpointed RDD keeps
    # the upstream plan (e.g. a scan + aggregate of the line facts) from running twice
    df = df.checkpoint(eager=False)
    hist = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gr_n"))
    pos = _prefix_positions(hist, order, F.col("_gr_n"), parts)
    value = F.col("_gr_before") + 1 if method == "rank" else F.col("_gr_pos")
    lookup = pos.select(*[F.col(k).alias(f"_gr_k{i}") for i, k in enumerate(keys)], value.cast("long").alias(name))
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(lookup[f"_gr_k{i}"])
        cond = c if cond is None else cond & c
    out = df.join(lookup, cond)
    return out.drop(*[f"_gr_k{i}" for i in range(len(keys))])
