"""Results of a batch of checkouts: invoices, closed orders, freed tables, loyalty points.

A checkout is one decision with several effects.  ``settle`` decides the batch once and writes the
decisions below the shared checkpoint folder; every result table is derived from what was written, so
they agree with each other whatever is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.scalar import MONEY_SUM
from tavola.operators.jobs import checkout_batch, checkout_requests
from tavola.operators.ranking import global_rank
from tavola.operators.reports import SALES_AS_OF
from tavola.operators.staged import staged
from tavola.sources.domain import Domain

# The payment methods of the three split columns.
SPLITS = {"cash_amount": ["cash"], "card_amount": ["card"], "transfer_amount": ["bank_transfer", "transfer"]}


def settle(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """The paid requests of the batch, decided and written once: those of ``checkout_batch`` with their payments."""
    req = staged(requests if requests is not None else checkout_requests(d), "checkouts")
    paid = checkout_batch(d, req).where(F.col("outcome") == "paid")
    return staged(paid.join(req.select("request_id", "payments"), "request_id"), "settled")


def _split(methods: list[str]) -> Column:
    own = F.filter("payments", lambda p: F.lower(p["method"]).isin(*methods))
    return F.aggregate(own, F.lit(0).cast("decimal(20,2)"), lambda acc, p: (acc + p["amount"]).cast("decimal(20,2)")).cast(MONEY_SUM)


def checkout_invoices(d: Domain, settled: DataFrame | None = None, paid_on: str = SALES_AS_OF) -> DataFrame:
    """The invoice row of every paid checkout: ids follow the stored ones in request order; amounts by method."""
    rows = settle(d) if settled is None else settled
    max_id = d.invoices.select(F.max("invoice_id")).scalar()
    rows = global_rank(rows, [F.col("request_id")], "_n", method="row_number")
    return rows.select(
        (F.coalesce(max_id, F.lit(0)) + F.col("_n")).alias("invoice_id"), "order_id", "customer_id", "sub_total", "discount_amount",
        "service_charge", "tax_amount", "total_amount", F.col("primary_method").alias("payment_method"),
        F.lit(paid_on).cast("date").alias("payment_date"), F.lit("paid").alias("status"),
        *[_split(methods).alias(name) for name, methods in SPLITS.items()],
    )


def checkout_orders(d: Domain, settled: DataFrame | None = None) -> DataFrame:
    """The orders that the batch closed, with the customer that the checkout gave them."""
    rows = (settle(d) if settled is None else settled).select("order_id", F.col("customer_id").alias("new_customer"))
    old = d.dine_orders.select("order_id", "table_id", F.col("customer_id").alias("old_customer"), F.col("status").alias("old_status"))
    return rows.join(old, "order_id").select(
        "order_id", "table_id", "old_customer", F.col("new_customer").alias("customer_id"), "old_status", F.lit("closed").alias("status")
    )


def checkout_tables(d: Domain, settled: DataFrame | None = None) -> DataFrame:
    """The tables that the batch freed, and the orders still waiting there."""
    rows = settle(d) if settled is None else settled
    freed = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("orders_closed"))
    left = d.dine_orders.where(F.col("status") != "closed").select("order_id", "table_id").join(rows.select("order_id"), "order_id", "left_anti")
    waiting = left.groupBy("table_id").agg(F.count(F.lit(1)).alias("orders_left"))
    old = d.dining_tables.select("table_id", F.lower("status").alias("old_status"))
    return old.join(freed, "table_id").join(waiting, "table_id", "left").select(
        "table_id", "old_status", F.lit("available").alias("status"), "orders_closed", F.coalesce("orders_left", F.lit(0)).alias("orders_left")
    )


def checkout_points(d: Domain, settled: DataFrame | None = None) -> DataFrame:
    """The balances of the customers who earned points with the batch."""
    rows = (settle(d) if settled is None else settled).where((F.col("points_earned") > 0) & F.col("customer_id").isNotNull())
    earned = rows.groupBy("customer_id").agg(F.sum("points_earned").cast("long").alias("earned"), F.count(F.lit(1)).alias("checkouts"))
    return d.customers.select("customer_id", F.col("loyalty_points").alias("old_points")).join(earned, "customer_id").select(
        "customer_id", "checkouts", "old_points", "earned", (F.col("old_points") + F.col("earned")).cast("long").alias("new_points")
    )
