"""Tables written once below the shared checkpoint folder, to cut lineage and be read many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tavola.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder below the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tavola-staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table and finished stream of this checkpoint folder; call it when the results are written."""
    for name in ("tavola-staged", "tavola-streams"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
