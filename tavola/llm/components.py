"""Connected components over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tavola.llm.staging import stage
from tavola.operators import graph


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root) of every vertex with an edge to another; the root is the smallest vertex."""
    return graph.components(edges, a, b, keep=lambda df: stage(df, "edges"))
