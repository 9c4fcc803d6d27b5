"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A random permutation cut into shards sends a certain number of each partition's rows to
each shard.  Those numbers are drawn first, as a multivariate hypergeometric matrix with
the partitions' row counts and the shards' sizes as margins.  Every partition then permutes
its own rows' labels, rows are exchanged, and each shard is permuted again.  All
permutations are equally likely, shard sizes are exact (counts differ by one at most), and no task
sees more than its partition or a range of a shard.

The matrix has a row per input partition and a column per shard; its size is bounded by
``MAX_PARTITIONS`` rows.  The input is written once to the shared folder first, so that a retried task
meets the same rows in the same order.

The second permutation orders a shard by a seeded 64-bit hash of each row's place in the input (its partition
and its number there), so equal rows are spread like any others.  Slots come
from counts of about sqrt(n) hash ranges and a sort inside each, so a shard is never
sorted by one task.

Defined cases: an empty table gives no rows; fewer rows than shards leave the last shards empty; equal rows
are rows of their own; nulls are values like any other; the columns of the input are kept, those called shard or
slot (in any case) under that name with ``_before`` behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tavola.llm.staging import stage
from tavola.session import ensure_checkpoint_dir

#: Partitions of the input at most; more are coalesced.
MAX_PARTITIONS = 20_000


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; shard sizes differ by one at most."""
    total = sum(rows)
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        after = int(left.sum())
        for s in range(shards):
            after -= int(left[s])
            out[p, s] = k = hypergeometric(rng, int(left[s]), after, n)
            n -= k
        left -= out[p]
    return out


#: Standard deviations around the mode that a draw beyond numpy's range looks at; the rest has a chance below 1e-30.
_REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good.

    Beyond 1e9 items, where numpy's generator stops, the chances of all counts near the mode are built up from
    their exact ratios and summed, so they make one whole whatever the size.
    """
    total = good + bad
    if not n or not total:
        return 0
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(_REACH * spread) + 64
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)  # from k to k + 1
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs[mode - first]))
    return first + int(np.searchsorted(chances, rng.random() * chances[-1], side="right").clip(0, last - first))


def _label(matrix, seed: int) -> Callable:
    """Gives the rows of a partition their shards in permuted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        counts = matrix.value[p] if p < len(matrix.value) else np.zeros(0, dtype=np.int64)
        labels = np.random.default_rng([seed, p]).permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        at = 0
        for batch in batches:
            own = labels[at : at + batch.num_rows]
            place = (p << 40) + np.arange(at, at + batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(place)], names=[*batch.schema.names, "shard", "place"])
        if at != len(labels):
            raise RuntimeError(f"partition {p} has {at} rows, {len(labels)} were counted")

    return run


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard)."""
    names = [c + "_before" if c.lower() in ("shard", "slot") else c for c in df.columns]
    fixed = df.toDF(*[f"c{k}" for k in range(len(names))]).coalesce(MAX_PARTITIONS)
    ensure_checkpoint_dir(df.sparkSession)
    fixed = fixed.checkpoint()  # the same partitions, rows and order from here on
    counted = {r["p"]: r["count"] for r in fixed.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # a number per partition
    rows = [counted.get(p, 0) for p in range(max(counted, default=-1) + 1)]
    matrix = df.sparkSession.sparkContext.broadcast(communication_matrix(rows, shards, seed))
    labelled = fixed.mapInArrow(_label(matrix, seed), StructType([*fixed.schema.fields]).add("shard", IntegerType()).add("place", LongType()))

    keyed = stage(labelled.withColumn("key", F.xxhash64(F.lit(seed), "place")), "labelled")
    ranges = max(1, int((sum(rows) / shards) ** 0.5))
    part = F.floor((F.shiftrightunsigned("key", 32).cast("double") / 2.0**32) * ranges).cast("long")
    keyed = keyed.withColumn("range", part)
    sizes = keyed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n"))
    placed = keyed.join(sizes.select("shard", "range", "start"), ["shard", "range"])
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "place")) - 1
    return placed.withColumn("slot", slot.cast("long")).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "shard", "slot")
