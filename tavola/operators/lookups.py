"""Scalar rules applied to whole tables, searches, sorts and lists.

Searches are plain ``filter``s of built-in string predicates: they stay inside
whole-stage codegen and need no shuffle.  Keywords are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.scalar import (
    MONEY_SUM, discount_pct, format_vnd, points_benefit, points_tier, service_charge,
)
from tavola.operators.ranking import global_rank
from tavola.operators.views import invoice_list
from tavola.sources.domain import Domain


# ------------------------------------------------------------------------ J1
def customer_discounts(d: Domain) -> DataFrame:
    return d.customers.select("customer_id", "loyalty_points", discount_pct(F.col("loyalty_points")).alias("discount_pct"))


# ------------------------------------------------------------------------ J2
def invoice_service_charges(d: Domain) -> DataFrame:
    """Location-based service charge of every invoice's subtotal (unknown table -> 5 %)."""
    inv = d.invoices.select("invoice_id", "order_id", "sub_total")
    o = d.dine_orders.select("order_id", "table_id")
    t = d.dining_tables.select("table_id", "location")
    j = inv.join(o, "order_id", "left").join(t, "table_id", "left")
    return j.select("invoice_id", "table_id", "location", "sub_total",
                    service_charge(F.col("location"), F.col("sub_total")).alias("service_charge"))


# ------------------------------------------------------------------------ J3
def invoice_amount_text(d: Domain) -> DataFrame:
    return d.invoices.select("invoice_id", "total_amount", format_vnd(F.col("total_amount")).alias("total_vnd"))


# ------------------------------------------------------------------------ J4
def order_prep_time(d: Domain) -> DataFrame:
    """Per order: the longest preparation time of its dishes (kitchen works in parallel); 0 without lines."""
    lines = d.order_details.select("order_id", "dish_id")
    prep = d.menu_items.select("dish_id", "preparation_time")
    per_order = lines.join(prep, "dish_id").groupBy("order_id").agg(F.max("preparation_time").alias("_p"))
    o = d.dine_orders.select("order_id")
    return o.join(per_order, "order_id", "left").select(
        "order_id", F.coalesce(F.col("_p"), F.lit(0)).cast("int").alias("prep_time")
    )


# ------------------------------------------------------------------------ J5
def customer_tiers(d: Domain) -> DataFrame:
    p = F.col("loyalty_points")
    return d.customers.select("customer_id", "loyalty_points", points_tier(p).alias("tier"), points_benefit(p).alias("benefit"))


# ------------------------------------------------------------------------ F1
def leaderboard(d: Domain, n: int = 5) -> DataFrame:
    """Top-n customers by points (ties: id) with position, tier and benefit (the top-k is the feature)."""
    top = d.customers.orderBy(F.col("loyalty_points").desc(), F.col("customer_id")).limit(n)
    from pyspark.sql import Window

    # window over the n returned rows only
    pos = F.row_number().over(Window.orderBy(F.col("loyalty_points").desc(), F.col("customer_id")))
    p = F.col("loyalty_points")
    return top.select(
        pos.alias("position"), "customer_id", F.col("customer_name").alias("name"),
        F.col("phone_number").alias("phone"), F.col("loyalty_points").alias("points"),
        points_tier(p).alias("tier"), points_benefit(p).alias("benefit"),
    )


# ------------------------------------------------------------------------ B4
def customer_search(d: Domain, keyword: str = "12") -> DataFrame:
    kw = keyword.lower()
    c = d.customers
    hit = (
        F.lower(F.coalesce("customer_name", F.lit(""))).contains(kw)
        | F.coalesce("phone_number", F.lit("")).contains(kw)
        | F.lower(F.coalesce("email", F.lit(""))).contains(kw)
    )
    return c.where(hit).select(
        F.col("customer_id").alias("id"), F.col("customer_name").alias("name"),
        F.col("phone_number").alias("phone"), "email", F.col("loyalty_points").alias("points"),
    )


# ------------------------------------------------------------------------ B5
def invoice_search(d: Domain, keyword: str = "walk") -> DataFrame:
    kw = keyword.lower()
    inv = invoice_list(d)
    hit = F.col("id").cast("string").contains(kw) | F.lower(F.coalesce("customer", F.lit(""))).contains(kw)
    return inv.where(hit)


# ------------------------------------------------------------------------ B6
def menu_search(d: Domain, category: str | Column = "All", keyword: str = "ring") -> DataFrame:
    """Menu rows of a category ('All' = any; a column or scalar names one too) whose name contains the keyword (case-insensitive)."""
    m = d.menu_items.select(
        F.col("dish_id").alias("id"), F.col("dish_name").alias("name"), "price",
        F.trim(F.coalesce("category_name", F.lit("Uncategorized"))).alias("category"),
    )
    cond = F.lower("name").contains(keyword.lower())
    if not isinstance(category, str) or category != "All":
        cond = cond & (F.coalesce(F.col("category"), F.lit("Others")) == category)
    return m.where(cond)


# ------------------------------------------------------------------------ F4
def customer_sorted(d: Domain, mode: str = "points_desc") -> DataFrame:
    """Customer list with its display position under a sort mode.

    The page sorts the id-descending directory with a stable sort, so ties keep
    id-descending order.  Positions come from a distributed global row_number.
    """
    c = d.customers.select(F.col("customer_id").alias("id"), F.col("customer_name").alias("name"),
                           F.col("loyalty_points").alias("points"))
    keys = {
        "points_desc": [F.col("points").desc(), F.col("id").desc()],
        "name_asc": [F.collate(F.col("name"), "UNICODE").asc(), F.col("id").desc()],
        "id_asc": [F.col("id").asc()],
        "id_desc": [F.col("id").desc()],
    }[mode]
    return global_rank(c, keys, "position", method="row_number")


# ------------------------------------------------------------------------ G1
def category_list(d: Domain) -> DataFrame:
    """'All' followed by the distinct (trimmed) menu categories, with display position."""
    first_seen = d.menu_items.groupBy(F.trim(F.coalesce("category_name", F.lit("Uncategorized"))).alias("category")).agg(
        F.min("dish_id").alias("first_id")
    )
    all_row = d.spark.createDataFrame([("All", -1)], "category string, first_id long")
    both = all_row.unionByName(first_seen)
    # one row per category: the list is bounded by the category domain, a plain window is enough
    from pyspark.sql import Window

    return both.select(F.row_number().over(Window.orderBy("first_id")).alias("position"), "category")


# ------------------------------------------------------------------------ B13
def pos_categories(d: Domain) -> DataFrame:
    """POS category strip: 'All' then the category names in stored order."""
    cats = d.categories.select(F.col("category_id").alias("_k"), F.col("category_name").alias("category"))
    all_row = d.spark.createDataFrame([(0, "All")], "_k long, category string")
    from pyspark.sql import Window

    # bounded by the category domain (one row per category)
    return all_row.unionByName(cats).select(F.row_number().over(Window.orderBy("_k")).alias("position"), "category")


def pos_tables(d: Domain) -> DataFrame:
    return d.dining_tables.select(F.col("table_id").alias("id"), "status")


# ------------------------------------------------------------------------ B15
def dish_prefix(d: Domain, prefix: str = "red") -> DataFrame:
    """Name-prefix search (LIKE 'x%'): ``startswith`` is pushed to the parquet scan."""
    return d.menu_items.where(F.col("dish_name").startswith(prefix)).select("dish_id", "dish_name", "price")


def reservations_between(d: Domain, start: str = "2024-01-10 00:00:00", end: str = "2024-01-12 23:59:59") -> DataFrame:
    """Reservations in a time range (BETWEEN, inclusive); pushed to the parquet scan."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return d.reservations.where(F.col("reserved_at").between(lo, hi)).select(
        "reservation_id", "customer_id", "table_id", "reserved_at", "status"
    )


# ------------------------------------------------------------------------ B11
def menu_item(d: Domain, dish_id: int) -> DataFrame:
    from tavola.operators.views import menu_catalog

    return menu_catalog(d, ordering="id").where(F.col("id") == dish_id)


def invoice_detail(d: Domain, invoice_id: int | Column) -> dict[str, DataFrame]:
    """Point lookup of one invoice: header, items and split payments (filters reach every scan)."""
    from tavola.operators.views import invoice_list, receipt_items, split_payments

    return {
        "info": invoice_list(d).where(F.col("id") == invoice_id),
        "items": receipt_items(d).where(F.col("invoice_id") == invoice_id),
        "payments": split_payments(d).where(F.col("invoice_id") == invoice_id),
    }


# ------------------------------------------------------------------------ D17
def order_subtotals(d: Domain) -> DataFrame:
    """Σ qty x price per order, 0 for orders without lines."""
    o = d.dine_orders.select("order_id")
    return o.join(d.order_totals.select("order_id", "sub_total"), "order_id", "left").select(
        "order_id", F.coalesce(F.col("sub_total"), F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM).alias("sub_total")
    )


# ------------------------------------------------------------------- F2 / F3
def floor_page(d: Domain, n: int = 15) -> DataFrame:
    """The floor screen: the first n tables by id (the page size is the feature)."""
    from tavola.operators.views import floor_view

    tables = d.dining_tables.orderBy("table_id").limit(n)
    orders = d.dine_orders.join(tables.select("table_id"), "table_id", "left_semi")
    return floor_view(d.with_tables(dining_tables=tables, dine_orders=orders)).orderBy("id")


def latest_invoices(d: Domain, n: int = 50) -> DataFrame:
    """The invoice screen: the n most recent invoices by id."""
    from tavola.operators.views import invoice_list

    ids = d.invoices.select("invoice_id").orderBy(F.col("invoice_id").desc()).limit(n)
    own = d.with_tables(
        invoices=d.invoices.join(ids, "invoice_id", "left_semi"),
        payments=d.payments.join(ids, "invoice_id", "left_semi"),
    )
    return invoice_list(own)


# ---------------------------------------------------------------- SQL API
def register_table_functions(d: Domain) -> None:
    """The revenue procedure as a SQL table function: ``SELECT * FROM monthly_revenue(2001, 7)``."""
    from tavola.operators.reports import paid_invoices

    paid_invoices(d).createOrReplaceTempView("tavola_paid_invoices")
    d.spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION monthly_revenue(in_year INT, in_month INT)
        RETURNS TABLE (day DATE, bills BIGINT, revenue DECIMAL(18,2), discounts DECIMAL(18,2), avg_bill DECIMAL(18,2))
        RETURN SELECT payment_date, count(invoice_id), CAST(sum(total_amount) AS DECIMAL(18,2)), CAST(sum(discount_amount) AS DECIMAL(18,2)),
          CAST(CAST((CAST(sum(total_amount) * 100 AS BIGINT) * 2 + count(invoice_id)) DIV (2 * count(invoice_id)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))
        FROM tavola_paid_invoices
        WHERE payment_date >= make_date(in_year, in_month, 1) AND payment_date < add_months(make_date(in_year, in_month, 1), 1)
        GROUP BY payment_date""")


def monthly_revenue_via_sql(d: Domain) -> DataFrame:
    """J6 from SQL: the table function in FROM."""
    register_table_functions(d)
    return d.spark.sql("SELECT * FROM monthly_revenue(2001, 7) ORDER BY day")


def discounts_via_sql(d: Domain) -> DataFrame:
    """The scalar rules through Spark SQL: SQL-language functions over a table given by name."""
    from tavola.functions.scalar import register_sql_functions

    register_sql_functions(d.spark)
    return d.spark.sql(
        "SELECT customer_id, loyalty_points, discount_pct(loyalty_points) AS discount_pct, "
        "points_tier(loyalty_points) AS tier FROM {customers}",
        customers=d.customers,
    )
