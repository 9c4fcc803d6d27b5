"""Sales and revenue reports.

All functions take a ``Domain`` and return a lazy DataFrame.  Aggregations are
written so the big fact (order lines) is reduced by a partial+final hash
aggregate *before* it meets any dimension: the dimension join then sees one row
per dish / day / customer instead of one row per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.scalar import MONEY_SUM, dec, hour_label
from tavola.operators.ranking import global_rank
from tavola.sources.domain import Domain

# Default "now" of the sales reports: the day after the last order date in the data.
SALES_AS_OF = "2001-08-02 00:00:00"


def ts(value) -> Column:
    return F.lit(value).cast("timestamp_ntz") if not isinstance(value, Column) else value


def idiv(a: Column, b: Column) -> Column:
    """Integer division of non-negative integers (exact; no floating point)."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def _avg_money(total: Column, count: Column) -> Column:
    """Exact average to the cent, half up: integer arithmetic on cents."""
    cents = (total * 100).cast("long")
    q = idiv(cents * 2 + count, count * 2)
    return (q.cast("decimal(18,0)") * dec("0.01")).cast(MONEY_SUM)


def share_tenths(part: Column, whole: Column) -> Column:
    """part / whole in percent, one decimal, rounded half up (exact)."""
    tenths = idiv(part * 2000 + whole, whole * 2)
    return (tenths.cast("decimal(18,0)") * dec("0.1")).cast("decimal(5,1)")


def money_text(amount: Column) -> Column:
    """f"{x:,.0f} VND" of a binary float (half-even on the exact binary value)."""
    return F.concat(F.format_number(amount.cast("double"), 0), F.lit(" VND"))


# --------------------------------------------------------------------- D1/E1
def top_selling_dishes(d: Domain, as_of=SALES_AS_OF, days: int = 30) -> DataFrame:
    """Dishes sold in orders of the last ``days`` days, ranked by quantity."""
    start = ts(as_of) - F.make_dt_interval(F.lit(days))
    recent = d.orders_since(start).select("order_id")
    lines = d.order_details
    if "order_month" in lines.columns:  # stored layout: older months are not read
        lines = lines.where(F.col("order_month") >= F.trunc(F.to_date(start), "month"))
    lines = lines.select("order_id", "dish_id", "quantity", "line_total").join(recent, "order_id", "left_semi")
    per_dish = lines.groupBy("dish_id").agg(
        F.sum("quantity").cast("long").alias("total_quantity_sold"),
        F.sum("line_total").cast(MONEY_SUM).alias("total_revenue"),
        F.countDistinct("order_id").alias("order_count"),
    )
    dishes = d.menu_items.where(F.col("category_id").isNotNull()).select("dish_id", "dish_name", "category_name", "price")
    out = per_dish.join(dishes, "dish_id")
    out = global_rank(out, [F.col("total_quantity_sold").desc()], "sales_rank", keys=["total_quantity_sold"])
    return out.select(
        "dish_id", "dish_name", "category_name", "price",
        "total_quantity_sold", "total_revenue", "order_count", "sales_rank",
    )


# ------------------------------------------------------------------------ D2
def paid_invoices(d: Domain) -> DataFrame:
    return d.invoices.where(F.col("status") == "paid")


def daily_revenue(d: Domain) -> DataFrame:
    """Paid revenue by day; ``position`` counts from the newest day."""
    agg = paid_invoices(d).groupBy(F.col("payment_date").alias("revenue_date")).agg(
        F.count("invoice_id").alias("invoice_count"),
        F.sum("sub_total").cast(MONEY_SUM).alias("gross_revenue"),
        F.sum("discount_amount").cast(MONEY_SUM).alias("total_discounts"),
        F.sum("service_charge").cast(MONEY_SUM).alias("total_service_charge"),
        F.sum("tax_amount").cast(MONEY_SUM).alias("total_tax"),
        F.sum("total_amount").cast(MONEY_SUM).alias("net_revenue"),
    )
    agg = agg.withColumn("avg_bill_amount", _avg_money(F.col("net_revenue"), F.col("invoice_count")))
    return global_rank(agg, [F.col("revenue_date").desc_nulls_last()], "position", method="row_number")


# ------------------------------------------------------------------------ D3
def monthly_revenue(d: Domain, year: int = 2001, month: int = 7) -> DataFrame:
    """Per-day bills of one month; the month test is a half-open date range so it can be pushed down."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    inv = paid_invoices(d).where((F.col("payment_date") >= first) & (F.col("payment_date") < F.add_months(first, 1)))
    if "payment_month" in inv.columns:  # stored layout: read one month partition
        inv = inv.where(F.col("payment_month") == first)
    agg = inv.groupBy(F.col("payment_date").alias("day")).agg(
        F.count("invoice_id").alias("bills"),
        F.sum("total_amount").cast(MONEY_SUM).alias("revenue"),
        F.sum("discount_amount").cast(MONEY_SUM).alias("discounts"),
    )
    return agg.withColumn("avg_bill", _avg_money(F.col("revenue"), F.col("bills"))).orderBy("day")


# ---------------------------------------------------------------------- D7/D6
def latest_months(invoices: DataFrame, n: int) -> DataFrame:
    """Of invoices stored by month, the newest months that hold ``n`` paid dates (or all months).

    Months come from the file listing; each look reads twice as many of the newest partitions as the one before, so
    history that the report doesn't show is not read.
    """
    months = sorted({part.split("=", 1)[1] for f in invoices.inputFiles() for part in f.split("/") if part.startswith("payment_month=")}, reverse=True)
    months = [m for m in months if not m.startswith("__HIVE")]
    taken = 1
    while taken < len(months):
        some = invoices.where(F.col("payment_month") >= F.lit(months[taken - 1]).cast("date"))
        if some.where(F.col("status") == "paid").select("payment_date").distinct().limit(n).count() >= n:
            return some
        taken *= 2
    return invoices


def revenue_latest_days(d: Domain, n: int = 7) -> DataFrame:
    """Paid revenue of the latest ``n`` dates that have revenue (top-k is the feature)."""
    if "payment_month" in d.invoices.columns:  # stored layout
        d = d.with_tables(invoices=latest_months(d.invoices, n))
    agg = paid_invoices(d).groupBy(F.col("payment_date").alias("date")).agg(
        F.count("invoice_id").alias("order_count"),
        F.sum("total_amount").cast(MONEY_SUM).alias("daily_revenue"),
    )
    return agg.orderBy(F.col("date").desc_nulls_last()).limit(n)


def _period_rows(df: DataFrame, period: Column) -> DataFrame:
    g = df.groupBy(period.alias("period")).agg(
        F.sum("order_count").cast("long").alias("orders"),
        F.sum("daily_revenue").cast(MONEY_SUM).alias("gross"),
        F.max("date").alias("date"),
    )
    return _money_columns(g)


def _money_columns(g: DataFrame) -> DataFrame:
    """The report's columns; ``position`` counts from the newest period (a window over the report's few rows)."""
    gross = F.col("gross").cast("double")
    return g.select(
        F.row_number().over(Window.orderBy(F.col("date").desc())).alias("position"), "period", "orders", "gross",
        money_text(gross * F.lit(0.92)).alias("net_text"),
        money_text(gross * F.lit(0.08)).alias("tax_text"),
        money_text(gross).alias("gross_text"),
    )


def revenue_report(d: Domain, grain: str = "week", dates: int = 30, day_rows: int = 7, latest: DataFrame | None = None) -> DataFrame:
    """Dashboard revenue report over the latest ``dates`` revenue dates, by day / ISO week / month.

    ``latest`` may hold those dates already (``revenue_latest_days``), for several reports to share.
    """
    latest = revenue_latest_days(d, dates) if latest is None else latest
    if grain == "day":
        rows = latest.orderBy(F.col("date").desc()).limit(day_rows).select(
            F.col("date").cast("string").alias("period"),
            F.col("order_count").cast("long").alias("orders"),
            F.col("daily_revenue").alias("gross"), "date",
        )
        return _money_columns(rows)
    if grain == "week":
        label = F.concat(F.lit("Week "), F.weekofyear("date").cast("string"), F.lit(", "), F.year("date").cast("string"))
    elif grain == "month":
        label = F.date_format("date", "MMMM yyyy")
    else:
        raise ValueError(grain)
    return _period_rows(latest, label)


# ---------------------------------------------------------------------- D8/D9/D19
def dish_sales(d: Domain, facts: DataFrame | None = None) -> DataFrame:
    """All-time quantity per dish (inner join: dishes never sold do not appear); ``facts``: see ``basket.shared_order_dishes``."""
    per_dish = (d.order_details if facts is None else facts).groupBy("dish_id").agg(F.sum("quantity").cast("long").alias("total_sold"))
    return per_dish.join(d.menu_items.select("dish_id", "dish_name", "price"), "dish_id")


def top_dishes(d: Domain, n: int = 5, facts: DataFrame | None = None) -> DataFrame:
    return dish_sales(d, facts).orderBy(F.col("total_sold").desc(), F.col("dish_id")).limit(n).select(
        "dish_id", "dish_name", "total_sold"
    )


def slowest_dish(d: Domain) -> DataFrame:
    return dish_sales(d).orderBy(F.col("total_sold"), F.col("dish_id")).limit(1).select(
        "dish_id", "dish_name", "total_sold"
    )


def menu_performance(d: Domain, n: int = 8, facts: DataFrame | None = None) -> DataFrame:
    """Top-n table: position, revenue = menu price x units, share of the n rows, status."""
    top = dish_sales(d, facts).orderBy(F.col("total_sold").desc(), F.col("dish_id")).limit(n)
    # the window runs on the n returned rows only (n is the report size)
    w_all = Window.partitionBy()
    w_pos = Window.orderBy(F.col("total_sold").desc(), F.col("dish_id"))
    pos = F.row_number().over(w_pos)
    total = F.sum("total_sold").over(w_all)
    return top.select(
        pos.alias("rank"),
        "dish_id",
        F.col("dish_name").alias("name"),
        F.col("total_sold").alias("sold"),
        money_text(F.col("price").cast("double") * F.col("total_sold")).alias("revenue"),
        F.when(total > 0, share_tenths(F.col("total_sold"), total)).otherwise(dec("0.0")).cast("decimal(5,1)").alias("percentage"),
        F.when(pos == 1, "best").when(pos <= 3, "good").otherwise("average").alias("status"),
    )


# ------------------------------------------------------------------------ D16
def orders_by_hour(d: Domain) -> DataFrame:
    agg = d.dine_orders.groupBy(F.hour("order_time").alias("hr")).agg(F.count(F.lit(1)).alias("volume"))
    return agg.select("hr", hour_label(F.col("hr")).alias("label"), "volume").orderBy("hr")


# ------------------------------------------------------------------------ D20
def customer_spend(d: Domain) -> DataFrame:
    per_customer = paid_invoices(d).groupBy("customer_id").agg(F.sum("total_amount").cast(MONEY_SUM).alias("total_spent"))
    return per_customer.join(d.customers.select("customer_id", "customer_name"), "customer_id").select(
        "customer_id", "customer_name", "total_spent"
    )
