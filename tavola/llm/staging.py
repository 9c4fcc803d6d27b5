"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

A staged table is a Parquet folder: it cuts lineage, survives lost executors, and its size
is known to the planner, which then broadcasts it only below the session's threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tavola.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
