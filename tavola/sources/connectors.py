"""Sources and sinks.

The reference's only connector is a MySQL connection.  Here tables come from
files (parquet by default; csv/json/orc through the same reader) or, for a live
database, from ``spark.read.jdbc`` split into parallel range reads.  Results
leave through DataFrame writers (or ``writeStream`` for streams).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_mysql(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int = 8,
    fetch_size: int = 10000,
) -> DataFrame:
    """A table of a live MySQL database, read by ``num_partitions`` parallel range queries.

    Give an indexed numeric ``partition_column`` (e.g. the auto-increment id)
    with its bounds; without one the table is read by a single task.
    """
    props = {"user": user, "password": password, "fetchsize": str(fetch_size), "driver": "com.mysql.cj.jdbc.Driver"}
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower_bound, upperBound=upper_bound,
        numPartitions=num_partitions, properties=props,
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a result; large facts are best partitioned by a date column (e.g. payment_date)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def export_reports(spark: SparkSession, sf_dir: str, out_dir: str, names: list[str], fmt: str = "json") -> dict[str, str]:
    """Run catalogued queries and write each result under ``out_dir/<name>`` (the API's JSON documents)."""
    from tavola.plans import catalog

    written = {}
    for name in names:
        path = f"{out_dir.rstrip('/')}/{name}"
        write_table(catalog.run(spark, sf_dir, name), path, fmt)
        written[name] = path
    return written
