"""Column defaults and status normalisation of the schema.

Parquet has no DEFAULT clause: missing values get the DDL default on read, and
enum-like statuses are lower-cased (the schema's collation is case-insensitive:
'Confirmed' = 'confirmed').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# DDL defaults per table (None = the load date, i.e. ``as_of``).
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"join_date": None, "loyalty_points": 0, "is_active": True},
    "staff": {"is_active": True},
    "dining_tables": {"location": "Main Hall", "status": "available"},
    "menu_items": {"is_available": True, "preparation_time": 15},
    "reservations": {"status": "pending"},
    "dine_orders": {"status": "open"},
    "invoices": {"discount_amount": 0, "service_charge": 0, "tax_amount": 0, "status": "unpaid"},
}
STATUS_COLUMNS = {"status", "payment_method", "method", "role"}


def apply_defaults(df: DataFrame, table: str, as_of: str | None = "2024-01-15") -> DataFrame:
    """Statuses in lower case and DDL defaults in place of NULL; without ``as_of`` dates stay as they are."""
    rules = DEFAULTS.get(table, {})
    cols: list[Column] = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if name in STATUS_COLUMNS:
            c = F.lower(c)
        if name in rules and (rules[name] is not None or as_of is not None):
            default = rules[name]
            fill = F.lit(as_of).cast("date") if default is None else F.lit(default)
            c = F.coalesce(c, fill.cast(dtype))
        cols.append(c.alias(name))
    return df.select(*cols)
