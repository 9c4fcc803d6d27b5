"""Live KPIs and rule-based insights.

Each insight rule is a small DataFrame derived from the tables (a one-row
top-1 or an empty frame when the rule does not fire); the rules are combined
with ``unionByName``.  One-row values that feed another row use scalar
subqueries, never cross joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.operators.basket import shared_order_dishes, top_rules
from tavola.operators.reports import dish_sales, money_text, revenue_latest_days
from tavola.operators.staged import staged
from tavola.sources.domain import Domain

# Insight texts of the dashboard (rule B) and our English wording of rule set A.
STAFFING_TITLE = "Peak Traffic Alert"
STAFFING_MESSAGE = "High volume of orders detected. Recommend reallocating staff."
OVERLOAD_THRESHOLD = 30

INSIGHT_COLUMNS = ["position", "category", "title", "message", "color"]


def kpis(d: Domain, latest: DataFrame | None = None) -> DataFrame:
    """One row: latest revenue date's revenue and bills, occupancy %, guests at occupied tables.

    ``latest`` may hold the newest revenue dates already.
    """
    latest = revenue_latest_days(d, 1) if latest is None else latest.orderBy(F.col("date").desc_nulls_last()).limit(1)
    t = d.dining_tables
    occupied = F.col("status") == "occupied"
    agg = t.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum(F.when(occupied, 1).otherwise(0)), F.lit(0)).alias("occupied_tables"),
        F.coalesce(F.sum(F.when(occupied, F.col("capacity")).otherwise(0)), F.lit(0)).alias("live_guests"),
    )
    total = F.when(F.col("total_tables") > 0, F.col("total_tables")).otherwise(F.lit(1))
    # one scalar: the paid invoices are aggregated once
    agg = agg.withColumn("_day", latest.select(F.struct("date", "daily_revenue", "order_count")).scalar())
    revenue = F.coalesce(F.col("_day.daily_revenue"), F.lit(0).cast("decimal(18,2)"))
    return agg.select(
        F.col("_day.date").alias("revenue_date"),
        revenue.alias("revenue"),
        money_text(revenue).alias("revenue_text"),
        F.coalesce(F.col("_day.order_count"), F.lit(0)).cast("long").alias("orders"),
        ((F.col("occupied_tables") / total) * 100).cast("int").alias("occupancy"),
        F.concat(((F.col("occupied_tables") / total) * 100).cast("int").cast("string"), F.lit("%")).alias("occupancy_text"),
        F.col("live_guests").cast("long").alias("guests"),
    )


def _row(position: int, category: str, title: Column, message: Column, color: Column | str) -> list[Column]:
    return [
        F.lit(position).alias("position"),
        F.lit(category).alias("category"),
        title.alias("title"),
        message.alias("message"),
        (F.lit(color) if isinstance(color, str) else color).alias("color"),
    ]


def insights_dashboard(d: Domain, facts: DataFrame | None = None) -> DataFrame:
    """Rule set B: best pair, weakest of the top-8 dishes, constant staffing notice.

    Pairs and sales read one (order, dish) aggregate, so the order lines are scanned once.
    """
    facts = shared_order_dishes(d) if facts is None else facts
    best = top_rules(d, 1, facts).select(
        *_row(
            1, "Revenue Optimization",
            F.concat(F.lit("Combo Suggestion: "), F.col("source"), F.lit(" & "), F.col("target")),
            F.concat(F.lit("Cross-sell confidence is at "), F.col("confidence_pct").cast("string"),
                     F.lit("%. System auto-enabled upsell prompts.")),
            "green",
        )
    )
    top8 = dish_sales(d, facts).orderBy(F.col("total_sold").desc(), F.col("dish_id")).limit(8)
    last = top8.orderBy(F.col("total_sold").asc(), F.col("dish_id").desc()).limit(1).select(
        *_row(
            2, "Menu Strategy",
            F.concat(F.lit("Warning: '"), F.col("dish_name"), F.lit("'")),
            F.concat(F.lit("This item has only "), F.col("total_sold").cast("string"),
                     F.lit(" order(s). Consider removing it.")),
            "red",
        )
    )
    staffing = d.dining_tables.agg(F.count(F.lit(1)).alias("_n")).select(
        *_row(3, "Operations (HR)", F.lit(STAFFING_TITLE), F.lit(STAFFING_MESSAGE), "yellow")
    )
    return best.unionByName(last).unionByName(staffing)


def insights_rules(d: Domain, day: str = "2001-08-01", facts: DataFrame | None = None) -> DataFrame:
    """Rule set A: busiest hour of ``day``, least-sold dish, up to two upsell / weak-combo rules.

    Pairs and sales read one (order, dish) aggregate, so the order lines are scanned once.
    """
    facts = shared_order_dishes(d) if facts is None else facts
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    orders = d.dine_orders.where(
        (F.col("order_day") >= start - F.expr("INTERVAL 1 DAY"))
        & (F.col("order_time") >= start) & (F.col("order_time") < start + F.expr("INTERVAL 1 DAY"))
    )
    peak = (
        orders.groupBy(F.hour("order_time").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "hr").limit(1)
    )
    overload = F.col("n") >= OVERLOAD_THRESHOLD
    peak_row = peak.where(F.col("n") > 0).select(
        *_row(
            1, "Operations (HR)",
            F.concat(F.lit("Peak at "), F.col("hr").cast("string"), F.lit(":00")),
            F.concat(F.col("n").cast("string"), F.lit(" orders recorded. Status: "),
                     F.when(overload, "Overloaded").otherwise("Normal"),
                     F.lit(". Adjust staffing accordingly.")),
            F.when(overload, "yellow").otherwise("blue"),
        )
    )
    low = dish_sales(d, facts).orderBy(F.col("total_sold"), F.col("dish_id")).limit(1).select(
        *_row(
            2, "Menu",
            F.concat(F.lit("Slow seller '"), F.col("dish_name"), F.lit("'")),
            F.concat(F.lit("Only "), F.col("total_sold").cast("string"),
                     F.lit(" ordered. Consider removing it to ease the kitchen.")),
            "red",
        )
    )
    # window over the two selected rules only
    # the two rules feed two branches: written once, two rows
    rules = staged(top_rules(d, 2, facts), "top-rules").withColumn("_k", F.row_number().over(
        Window.orderBy(F.col("confidence").desc(), F.col("pair_count").desc(), "source", "target")))
    strong = rules.where(F.col("confidence_pct") >= 80).select(
        *_row(0, "Revenue Optimization",
              F.concat(F.lit("Combo "), F.col("source"), F.lit(" & "), F.col("target")),
              F.concat(F.lit("Bought together with "), F.col("confidence_pct").cast("string"),
                       F.lit("% confidence. Upsell prompt enabled.")),
              "green"),
        F.col("_k"),
    )
    weak = rules.where(F.col("confidence_pct") <= 20).select(
        *_row(0, "Risk Control",
              F.concat(F.lit("Weak combo '"), F.col("source"), F.lit("'")),
              F.concat(F.lit("Association only "), F.col("confidence_pct").cast("string"),
                       F.lit("%. Review this combo.")),
              "red"),
        F.col("_k"),
    )
    combos = strong.unionByName(weak)
    combos = combos.withColumn("position", (F.col("_k") + 2).cast("int")).drop("_k")
    return peak_row.unionByName(low).unionByName(combos.select(*INSIGHT_COLUMNS))
