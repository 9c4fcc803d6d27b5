"""Connected components by alternating large-star and small-star steps.

A step hangs every vertex on the smallest vertex around it; the rounds to the fixpoint
grow with the logarithm of the longest chain.  A step is two grouped minima (combined before
the shuffle) and two equi-joins that adaptive execution can split, so a vertex with very
many neighbours needs no large task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.session import ensure_checkpoint_dir


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over distinct edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(low, "u")
    moved = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select("u", F.col("m").alias("v")).union(moved).distinct()


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str, b: str, keep: Callable[[DataFrame], DataFrame] = _checkpoint) -> DataFrame:
    """(vertex, root) of every vertex with an edge to another; the root is the smallest vertex.

    Edges may repeat, loops are ignored, and an edge with a null end is no edge.
    ``keep`` cuts the lineage between rounds; there is no limit on their number.
    """
    e = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())
    before = None
    while True:
        seen = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            break
        before = seen
        e = keep(star_step(e))
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(roots)
