"""The full dashboard: a DataFrame for each section, and all of them in one table of texts.

The sections share what they read: the order lines are scanned once into an (order, dish) aggregate,
the newest revenue dates once, both written below the shared checkpoint folder.  Sections are then small
plans over those; the driver receives only their few rows.  ``tables`` shows the first 15 tables, like the
page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.operators import basket, insights, lookups, reports, views
from tavola.operators.staged import staged
from tavola.sources.domain import Domain

#: Tables, customers, dishes and pairs on the page, and the revenue dates of its reports.
TABLES, CUSTOMERS, DISHES, PAIRS, DATES = 15, 5, 8, 2, 30


def sections(d: Domain) -> dict[str, DataFrame]:
    facts = basket.shared_order_dishes(d)
    latest = staged(reports.revenue_latest_days(d, DATES), "latest-days")
    tables = d.dining_tables.orderBy("table_id").limit(TABLES)
    page = d.with_tables(dining_tables=tables, dine_orders=d.dine_orders.join(tables.select("table_id"), "table_id", "left_semi"))
    return {
        "kpi": insights.kpis(d, latest),
        "revenue_day": reports.revenue_report(d, "day", latest=latest),
        "revenue_week": reports.revenue_report(d, "week", latest=latest),
        "revenue_month": reports.revenue_report(d, "month", latest=latest),
        "peak_hours": reports.orders_by_hour(d),
        "dishes": reports.top_dishes(d, DISHES, facts),
        "top_dishes_table": reports.menu_performance(d, DISHES, facts),
        "tables": views.dashboard_floor(page, facts).orderBy("id"),
        "customers": lookups.leaderboard(d, CUSTOMERS),
        "market_basket": basket.top_rules(d, PAIRS, facts),
        "insights": insights.insights_dashboard(d, facts),
    }


def dashboard(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return sections(Domain(spark, sf_dir))


def dashboard_rows(d: Domain) -> DataFrame:
    """All sections as (section, position, name, value): the texts that the page shows, in its order."""

    def at(*order: Column) -> Column:
        return F.row_number().over(Window.orderBy(*order))  # over the few rows of a section

    def text(*parts) -> Column:
        return F.concat_ws(" | ", *[F.col(p).cast("string") for p in parts])

    found = sections(d)
    kpi = found.pop("kpi").select(F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("position"), F.lit(name).alias("name"), F.col(column).cast("string").alias("value"))
        for k, (name, column) in enumerate([("revenue", "revenue_text"), ("occupancy", "occupancy_text"), ("orders", "orders"), ("guests", "guests")])
    ])).alias("x")).select("x.*")
    shown = {
        **{f"revenue_{grain}": (F.col("position"), text("period"), text("orders", "net_text", "tax_text", "gross_text")) for grain in ("day", "week", "month")},
        "peak_hours": (at(F.col("hr")), text("label"), text("volume")),
        "dishes": (at(F.col("total_sold").desc(), F.col("dish_id")), text("dish_name"), text("total_sold")),
        "top_dishes_table": (F.col("rank"), text("name"), text("sold", "revenue", "percentage", "status")),
        "tables": (at(F.col("id")), text("id"), text("status", "capacity", "location", "order_total", "customer")),
        "customers": (F.col("position"), text("name"), text("phone", "points")),
        "market_basket": (at(F.col("pair_count").desc(), F.col("confidence").desc(), F.col("source"), F.col("target")), text("source", "target"), text("confidence_pct")),
        "insights": (F.col("position"), text("title"), text("category", "message", "color")),
    }
    out = kpi.select(F.lit("kpi").alias("section"), "position", "name", "value")
    for section, (position, name, value) in shown.items():
        out = out.unionByName(found[section].select(F.lit(section).alias("section"), position.cast("int").alias("position"), name.alias("name"), value.alias("value")))
    return out
