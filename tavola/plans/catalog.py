"""The catalogue of named queries.

Each entry maps a query name to a function ``Domain -> DataFrame`` using the
default parameters of the report.  ``queries()`` in ``__spark_entry__`` wraps
them as ``(spark, sf_dir) -> DataFrame``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators import reports as R
from tavola.operators import views as V
from tavola.operators import lookups as L
from tavola.operators import basket as B
from tavola.operators import insights as I
from tavola.operators import jobs as J
from tavola.operators import menu_writes as M
from tavola.operators import settlement as S
from tavola.operators import changes as C
from tavola.operators import quality as Q
from tavola.operators import defaults as DF
from tavola.plans.dashboard import dashboard_rows
from tavola.sources.domain import Domain

QueryFn = Callable[[Domain], DataFrame]
CATALOG: dict[str, QueryFn] = {}


def register(name: str, fn: QueryFn) -> None:
    if name in CATALOG:
        raise KeyError(f"duplicate query name {name}")
    CATALOG[name] = fn


# phase 1: reports
register("top_selling_dishes", R.top_selling_dishes)
register("daily_revenue", R.daily_revenue)
register("monthly_revenue", R.monthly_revenue)
register("revenue_latest_days", R.revenue_latest_days)
register("revenue_by_day", lambda d: R.revenue_report(d, "day"))
register("revenue_by_week", lambda d: R.revenue_report(d, "week"))
register("revenue_by_month", lambda d: R.revenue_report(d, "month"))
register("top_dishes", R.top_dishes)
register("menu_performance", R.menu_performance)
register("slowest_dish", R.slowest_dish)
register("orders_by_hour", R.orders_by_hour)
register("customer_spend", R.customer_spend)

# phase 2: joins and views
register("daily_reservations", V.daily_reservations)
register("table_availability", V.table_availability)
register("customer_activity", V.customer_activity)
register("safe_customers", V.safe_customers)
register("customer_directory", V.customer_directory)
register("menu_catalog", V.menu_catalog)
register("floor_view", V.floor_view)
register("dashboard_floor", V.dashboard_floor)
register("split_payments", V.split_payments)
register("invoice_list", V.invoice_list)
register("receipt_items", V.receipt_items)
register("receipt_change", V.receipt_change)
register("active_order_lines", V.active_order_lines)
register("payment_methods", V.payment_methods)

# phase 3: scalar rules, searches, sorts
register("discount_pct", L.customer_discounts)
register("service_charge", L.invoice_service_charges)
register("format_vnd", L.invoice_amount_text)
register("order_prep_time", L.order_prep_time)
register("points_tier", L.customer_tiers)
register("leaderboard", L.leaderboard)
register("customer_search", L.customer_search)
register("invoice_search", L.invoice_search)
register("menu_search", L.menu_search)
register("customer_sorted", L.customer_sorted)
register("customers_by_name", lambda d: L.customer_sorted(d, "name_asc"))
register("customers_by_id", lambda d: L.customer_sorted(d, "id_asc"))
register("customers_newest", lambda d: L.customer_sorted(d, "id_desc"))
register("category_list", L.category_list)

# phase 4: pair mining, KPIs, insights
register("basket_pairs", B.basket_pairs)
register("basket_rules", B.basket_rules)
register("basket_fpgrowth", B.basket_fpgrowth)
register("basket_itemsets", B.basket_itemsets)
register("basket_set_rules", B.basket_set_rules)
register("kpis", I.kpis)
register("insights_rules", I.insights_rules)
register("insights_dashboard", I.insights_dashboard)

# phase 5: set-based jobs
register("reservation_admission", J.reservation_admission)
register("reservation_batch", J.reservation_batch)
register("invoice_batch", J.invoice_batch)
register("checkout_batch", J.checkout_batch)
register("loyalty_accrual", J.loyalty_accrual)
register("loyalty_checkout", lambda d: J.loyalty_accrual(d, "checkout"))
register("cart_upsert", J.cart_upsert)
register("cart_orders", J.cart_orders)
register("cart_lines", J.cart_lines)
register("menu_upsert", J.menu_upsert)
register("customer_update", J.customer_update)
register("guarded_delete", J.guarded_delete)
register("duplicate_contacts", J.duplicate_contacts)
register("duplicate_contacts_sequential", J.duplicate_contacts_sequential)
register("table_clear", J.table_clear)

# phase 6: data quality and change-driven rules (batch twins of the streams)
register("constraint_report", Q.constraint_report)
register("table_state", C.table_state)
register("status_log", C.status_log)
register("reservation_completed", C.reservation_completed)
register("price_snapshot", C.price_snapshot)
register("maintenance_reject", C.maintenance_reject)
register("customer_audit", C.customer_audit)
register("hourly_activity", C.hourly_activity)
register("daily_activity", C.daily_activity)

# coverage additions: defaults, POS lists, prefix / range search, subtotals, pages, SQL path
register("customers_with_defaults", DF.customers_with_defaults)
register("pos_categories", L.pos_categories)
register("dish_prefix", L.dish_prefix)
register("reservations_between", L.reservations_between)
register("order_subtotals", L.order_subtotals)
register("floor_page", L.floor_page)
register("latest_invoices", L.latest_invoices)
register("discounts_via_sql", L.discounts_via_sql)
register("pos_tables", L.pos_tables)
register("menu_quick_update", J.menu_quick_update)
register("table_update", J.table_update)
register("table_update_closures", J.table_update_closures)

# results of a batch of checkouts and of full menu writes; receipts, menu orders, point look-ups, table function
register("checkout_invoices", S.checkout_invoices)
register("checkout_orders", S.checkout_orders)
register("checkout_tables", S.checkout_tables)
register("checkout_points", S.checkout_points)
register("menu_created", M.menu_created)
register("menu_categories_created", M.menu_categories_created)
register("menu_update", M.menu_update)
register("receipts", V.receipt_texts)
register("menu_newest", lambda d: V.menu_listed(d, "newest"))
register("menu_by_id", lambda d: V.menu_listed(d, "id"))
register("menu_search_category", lambda d: L.menu_search(d, d.menu_items.select(F.min("category_name")).scalar(), "e"))
register("menu_item", lambda d: L.menu_item(d, 77))
register("invoice_detail", lambda d: L.invoice_detail(d, d.invoices.select(F.max("invoice_id")).scalar())["items"])
register("monthly_revenue_sql", L.monthly_revenue_via_sql)
register("dashboard", dashboard_rows)
register("reservation_completions", C.reservation_completions)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in CATALOG:
        return CATALOG[name](Domain(spark, sf_dir))
    return _streams()[name](spark, sf_dir)


def _streams() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # phase 7: streams driven to completion (availableNow); each equals its batch twin
    from tavola.streaming.feeds import stream_queries

    return stream_queries()


def names() -> list[str]:
    return list(CATALOG) + list(_streams())


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(spark, sf_dir, _n)) for name in names()}
