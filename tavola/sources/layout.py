"""Stored layout of the domain tables.

``write_domain`` materialises the adapter's tables once as parquet: facts that
reports filter by date, order lines included, are partitioned by month.  Rows are dealt
by ranges of (month, sort key), so a busy month is many files of a bounded size, each with
narrow row-group statistics, and partition pruning plus those statistics take the place
of date indexes.  Other tables are dealt by ranges of their key.  ``StoredDomain`` reads them back with the
same interface as ``Domain``, so every operator runs unchanged on the stored
layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.sources.domain import Domain

# table -> (partition columns, sort columns)
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "categories": ([], []),
    "menu_items": ([], ["dish_id"]),
    "customers": ([], ["customer_id"]),
    "staff": ([], []),
    "dining_tables": ([], []),
    "dine_orders": (["order_month"], ["order_time"]),
    "order_details": (["order_month"], ["order_id"]),
    "order_totals": ([], ["order_id"]),
    "invoices": (["payment_month"], ["payment_date", "invoice_id"]),
    "payments": ([], ["invoice_id"]),
    "reservations": (["reserved_month"], ["reserved_at"]),
}


def _with_partition_columns(name: str, df: DataFrame, d: Domain) -> DataFrame:
    if name == "order_details":
        months = d.dine_orders.select("order_id", F.trunc(F.to_date("order_day"), "month").alias("order_month"))
        return df.join(months, "order_id", "left")
    if name == "dine_orders":
        return df.withColumn("order_month", F.trunc(F.to_date("order_day"), "month"))
    if name == "invoices":
        return df.withColumn("payment_month", F.trunc("payment_date", "month"))
    if name == "reservations":
        return df.withColumn("reserved_month", F.trunc(F.to_date("reserved_at"), "month"))
    return df


def write_domain(d: Domain, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    written = {}
    for name, (parts, sort) in LAYOUT.items():
        df = _with_partition_columns(name, getattr(d, name), d)
        if parts or sort:
            df = df.repartitionByRange(*parts, *sort).sortWithinPartitions(*parts, *sort)
        w = df.write.mode(mode)
        if parts:
            w = w.partitionBy(*parts)
        path = f"{out_dir.rstrip('/')}/{name}"
        w.parquet(path)
        written[name] = path
    return written


class StoredDomain(Domain):
    """A Domain whose tables are read from ``write_domain`` output instead of derived."""

    def __init__(self, spark: SparkSession, stored_dir: str, raw_dir: str):
        super().__init__(spark, raw_dir)  # raw tables stay available for request batches and feeds
        base = stored_dir.rstrip("/")
        for name in LAYOUT:
            # partition columns (order_month, payment_month, reserved_month) stay visible for pruning
            self.__dict__[name] = spark.read.parquet(f"{base}/{name}")
