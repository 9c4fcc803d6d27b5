"""Join-heavy views: reservations, floor state, customers, menu, invoices.

Correlated "latest order of the table" subqueries become one partial+final
aggregate per table (``max_by`` over ``(order_time, order_id)``) joined back;
correlated sums become pre-aggregates.  Nothing is evaluated per table row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.scalar import MONEY_SUM, mask_phone, membership_tier, payment_label
from tavola.operators.ranking import global_rank
from tavola.operators.reports import money_text, paid_invoices, ts
from tavola.sources.domain import Domain

# Default "now" of the reservation views (the change feed covers January 2024).
RES_AS_OF = "2024-01-15 00:00:00"

ACTIVE_ORDER = ["open", "preparing", "served"]


# ------------------------------------------------------------------------ B1
def daily_reservations(d: Domain) -> DataFrame:
    r = d.reservations
    c = d.customers.select("customer_id", "customer_name", "phone_number")
    t = d.dining_tables.select("table_id", "table_number", "capacity")
    s = d.staff.select("staff_id", F.col("staff_name").alias("handled_by"))
    return (
        r.join(c, "customer_id")
        .join(t, "table_id")
        .join(s, "staff_id", "left")
        .select(
            "reservation_id",
            F.to_date("reserved_at").alias("reservation_date"),
            F.date_format("reserved_at", "HH:mm:ss").alias("reservation_time"),
            "customer_name", "phone_number", "table_number", "capacity", "guest_count",
            "status", "special_requests", "handled_by",
        )
    )


# ------------------------------------------------------------------------ D4
# Status descriptions of the table-availability view.
TABLE_STATUS_TEXT = {
    "available": "Ready for seating",
    "reserved": "Has upcoming booking",
    "occupied": "Currently in use",
    "maintenance": "Out of service",
}


def status_description(status: Column) -> Column:
    expr = None
    for k, v in TABLE_STATUS_TEXT.items():
        expr = F.when(status == k, v) if expr is None else expr.when(status == k, v)
    return expr  # unknown status -> NULL


def table_availability(d: Domain, as_of=RES_AS_OF) -> DataFrame:
    """Upcoming pending/confirmed reservations per table (0 when none)."""
    upcoming = (
        d.reservations.where((F.col("reserved_at") >= ts(as_of)) & F.col("status").isin("pending", "confirmed"))
        .groupBy("table_id")
        .agg(F.count("reservation_id").alias("upcoming_reservations"))
    )
    t = d.dining_tables
    return t.join(upcoming, "table_id", "left").select(
        "table_id", "table_number", "capacity", "location", "status",
        status_description(F.col("status")).alias("status_description"),
        F.coalesce(F.col("upcoming_reservations"), F.lit(0)).cast("long").alias("upcoming_reservations"),
    )


# ------------------------------------------------------------------------ D5
def customer_activity(d: Domain) -> DataFrame:
    """Reservations, paid invoices reached through reservations, spend and tier per customer."""
    res = d.reservations.select("reservation_id", "customer_id")
    n_res = res.groupBy("customer_id").agg(F.countDistinct("reservation_id").alias("total_reservations"))
    # an inner join on the reference keeps exactly the orders whose reservation exists
    orders = d.dine_orders.select("order_id", F.col("reservation_ref").alias("reservation_id"))
    inv = paid_invoices(d).select("order_id", "invoice_id", "total_amount", "payment_date")
    spend = (
        res.join(orders, "reservation_id")
        .join(inv, "order_id")
        .groupBy("customer_id")
        .agg(
            F.countDistinct("invoice_id").alias("total_invoices"),
            F.sum("total_amount").cast(MONEY_SUM).alias("spent"),
            F.max("payment_date").alias("last_visit"),
        )
    )
    c = d.customers.select("customer_id", "customer_name", "phone_number", "loyalty_points")
    out = c.join(n_res, "customer_id", "left").join(spend, "customer_id", "left")
    total = F.coalesce(F.col("spent"), F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM)
    return out.select(
        "customer_id", "customer_name", "phone_number", "loyalty_points",
        F.coalesce("total_reservations", F.lit(0)).cast("long").alias("total_reservations"),
        F.coalesce("total_invoices", F.lit(0)).cast("long").alias("total_invoices"),
        total.alias("total_spent"),
        "last_visit",
        membership_tier(total).alias("membership_tier"),
    )


# ------------------------------------------------------------------------ B2/B3
def safe_customers(d: Domain) -> DataFrame:
    return d.customers.select(
        "customer_id", "customer_name", mask_phone(F.col("phone_number")).alias("masked_phone"), "loyalty_points"
    )


def customer_directory(d: Domain) -> DataFrame:
    c = d.customers
    return c.select(
        F.col("customer_id").alias("id"),
        F.col("customer_name").alias("name"),
        F.col("phone_number").alias("phone"),
        "email", "address",
        F.coalesce(F.col("join_date").cast("string"), F.lit("N/A")).alias("join_date"),
        F.col("loyalty_points").alias("points"),
        "is_active",
    ).orderBy(F.col("id").desc())


# ------------------------------------------------------------------------ B12
def _menu_ordering(kind: str) -> list[Column]:
    return {
        "category_name": lambda: [F.col("category").asc_nulls_first(), F.col("name").asc_nulls_first()],
        "newest": lambda: [F.col("id").desc()],
        "id": lambda: [F.col("id").asc()],
    }[kind]()


def menu_rows(d: Domain) -> DataFrame:
    """Menu with display defaults."""
    m = d.menu_items.select("dish_id", "category_id", "dish_name", "price", "description", "preparation_time", "is_available")
    cats = d.categories.select("category_id", F.col("category_name").alias("_cat"))
    return m.join(cats, "category_id", "left").select(
        F.col("dish_id").alias("id"),
        F.col("dish_name").alias("name"),
        F.coalesce(F.col("price"), F.lit(0).cast("decimal(10,2)")).alias("price"),
        F.coalesce(F.col("_cat"), F.lit("Uncategorized")).alias("category"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.when(F.col("preparation_time").isNull() | (F.col("preparation_time") == 0), F.lit(15))
        .otherwise(F.col("preparation_time")).cast("int").alias("prep_time"),
        F.coalesce(F.col("is_available"), F.lit(False)).alias("is_available"),
    )


def menu_catalog(d: Domain, ordering: str = "category_name") -> DataFrame:
    """Menu with display defaults; ordered by category then name (or newest-first / id)."""
    return menu_rows(d).orderBy(*_menu_ordering(ordering))


def menu_listed(d: Domain, ordering: str) -> DataFrame:
    """The menu with the position of every dish in the newest-first or the id order."""
    key = F.col("id").desc() if ordering == "newest" else F.col("id").asc()
    return global_rank(menu_rows(d), [key], "position", method="row_number")


# ---------------------------------------------------------------------- C5/E4
def latest_order_per_table(orders: DataFrame) -> DataFrame:
    """One row per table: the latest order (by order_time, then order_id) of ``orders``.

    A partial+final aggregate: a table with very many orders is reduced map-side,
    so a hot table never concentrates its rows in one task.
    """
    latest = orders.groupBy("table_id").agg(
        F.max_by(
            F.struct("order_id", "customer_id", "order_time"),
            F.struct("order_time", "order_id"),
        ).alias("o")
    )
    return latest.select("table_id", "o.order_id", "o.customer_id", "o.order_time")


def order_subtotals(d: Domain, orders: DataFrame) -> DataFrame:
    """Σ line_total per order of ``orders`` (semi-join first: only those orders' lines are aggregated)."""
    lines = d.order_details.select("order_id", "line_total").join(orders.select("order_id"), "order_id", "left_semi")
    return lines.groupBy("order_id").agg(F.sum("line_total").cast(MONEY_SUM).alias("sub_total"))


# ------------------------------------------------------------------------ L1
def floor_view(d: Domain) -> DataFrame:
    """Tables with their latest active order's customer, time and total, nulled out by table state."""
    active = d.dine_orders.where(F.col("status").isin(*ACTIVE_ORDER))
    latest = latest_order_per_table(active)
    totals = order_subtotals(d, latest)
    cust = d.customers.select("customer_id", "customer_name")
    cur = (
        latest.join(cust, "customer_id", "left")
        .join(totals, "order_id", "left")
        .select(
            "table_id",
            F.col("customer_name").alias("cur_customer"),
            F.date_format("order_time", "HH:mm").alias("cur_time"),
            F.col("sub_total").alias("cur_total"),
        )
    )
    t = d.dining_tables.select("table_id", "capacity", "location", F.lower("status").alias("status"))
    j = t.join(cur, "table_id", "left")
    status = F.col("status")
    zero = F.lit(0).cast(MONEY_SUM)
    total = F.coalesce(F.col("cur_total"), zero)
    return j.select(
        F.col("table_id").alias("id"), "capacity", "location", "status",
        F.when(status == "available", F.lit(None).cast("string"))
        .when(status == "reserved", F.coalesce("cur_customer", F.lit("Reserved Guest")))
        .otherwise(F.coalesce("cur_customer", F.lit("Walk-in Guest"))).alias("current_customer"),
        F.when(status == "available", F.lit(None).cast("string"))
        .when(status == "reserved", F.coalesce("cur_time", F.lit("Upcoming")))
        .otherwise(F.coalesce("cur_time", F.lit("--:--"))).alias("current_time"),
        F.when(status.isin("available", "reserved"), zero).otherwise(total).cast(MONEY_SUM).alias("current_total"),
    )


# ------------------------------------------------------------------------ L2
def dashboard_floor(d: Domain, facts: DataFrame | None = None) -> DataFrame:
    """Dashboard floor: latest non-closed order with a known customer; total of all non-closed orders.

    ``facts``: see ``basket.shared_order_dishes``.
    """
    open_orders = d.dine_orders.where(F.col("status") != "closed")
    known = open_orders.join(d.customers.select("customer_id", "customer_name"), "customer_id")
    latest = known.groupBy("table_id").agg(
        F.max_by("customer_name", F.struct("order_time", "order_id")).alias("customer_name")
    )
    lines = (d.order_details if facts is None else facts).select("order_id", "line_total").join(open_orders.select("order_id", "table_id"), "order_id")
    totals = lines.groupBy("table_id").agg(F.sum("line_total").cast(MONEY_SUM).alias("last_total"))
    t = d.dining_tables.select("table_id", "status", "capacity", "location")
    j = t.join(latest, "table_id", "left").join(totals, "table_id", "left")
    is_active = F.lower("status").isin("occupied", "reserved")
    return j.select(
        F.col("table_id").alias("id"), "status", "capacity",
        F.coalesce("location", F.lit("Dining Area")).alias("location"),
        F.when(is_active & F.col("last_total").isNotNull(), money_text(F.col("last_total")))
        .when(is_active, F.lit("0 VND")).otherwise(F.lit("-")).alias("order_total"),
        F.when(is_active & F.col("customer_name").isNotNull() & (F.col("customer_name") != ""), F.col("customer_name"))
        .when(is_active, F.lit("Walk-in Guest")).otherwise(F.lit("-")).alias("customer"),
    )


# ------------------------------------------------------------------------ D10
def split_payment_totals(d: Domain) -> DataFrame:
    """Cash / card / transfer sums per invoice (conditional sums: one aggregate, no pivot shuffle twice)."""
    p = d.payments
    m = F.lower("method")
    zero = F.lit(0).cast(MONEY_SUM)

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("amount"))), zero).cast(MONEY_SUM)

    return p.groupBy("invoice_id").agg(
        part(m == "cash").alias("cash_amount"),
        part(m == "card").alias("card_amount"),
        part(m.isin("bank_transfer", "transfer")).alias("transfer_amount"),
    )


def split_payments(d: Domain) -> DataFrame:
    """Rows (invoice, label, amount) for each positive split; none positive -> one Cash row of the total."""
    sp = split_payment_totals(d)
    inv = d.invoices.select("invoice_id", "total_amount")
    j = inv.join(sp, "invoice_id", "left")
    zero = F.lit(0).cast(MONEY_SUM)
    parts = F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Cash").alias("payment_method"), F.coalesce("cash_amount", zero).alias("amount")),
        F.struct(F.lit(2).alias("pos"), F.lit("Card").alias("payment_method"), F.coalesce("card_amount", zero).alias("amount")),
        F.struct(F.lit(3).alias("pos"), F.lit("Transfer").alias("payment_method"), F.coalesce("transfer_amount", zero).alias("amount")),
    )
    positive = F.filter(parts, lambda s: s["amount"] > 0)
    fallback = F.array(F.struct(F.lit(1).alias("pos"), F.lit("Cash").alias("payment_method"), F.col("total_amount").cast(MONEY_SUM).alias("amount")))
    rows = j.select("invoice_id", F.explode(F.when(F.size(positive) > 0, positive).otherwise(fallback)).alias("p"))
    return rows.select("invoice_id", F.col("p.pos").alias("position"), "p.payment_method", F.col("p.amount").cast(MONEY_SUM).alias("amount"))


# ------------------------------------------------------------------------ L4
def invoice_list(d: Domain) -> DataFrame:
    """All invoices with date text, customer (or Walk-in Guest), table and split amounts."""
    inv = d.invoices.select("invoice_id", "order_id", "customer_id", "payment_date", "total_amount", "status")
    o = d.dine_orders.select("order_id", "table_id")
    c = d.customers.select("customer_id", "customer_name")
    sp = split_payment_totals(d)
    named = inv.where(F.col("customer_id").isNotNull()).join(c, "customer_id", "left")
    walk_ins = inv.where(F.col("customer_id").isNull()).withColumn("customer_name", F.lit(None).cast("string"))
    # walk-ins have no key: kept out of the join, they do not meet in one task
    j = named.unionByName(walk_ins).join(o, "order_id").join(sp, "invoice_id", "left")
    zero = F.lit(0).cast(MONEY_SUM)
    return j.select(
        F.col("invoice_id").alias("id"),
        F.date_format("payment_date", "yyyy-MM-dd").alias("date"),
        F.coalesce(F.when(F.col("customer_name") != "", F.col("customer_name")), F.lit("Walk-in Guest")).alias("customer"),
        "table_id",
        F.coalesce(F.col("total_amount"), zero).alias("total"),
        "status",
        F.coalesce("cash_amount", zero).alias("cash_amount"),
        F.coalesce("card_amount", zero).alias("card_amount"),
        F.coalesce("transfer_amount", zero).alias("transfer_amount"),
    ).orderBy(F.col("id").desc())


# ------------------------------------------------------------------------ A5
def receipt_items(d: Domain) -> DataFrame:
    """Item lines of every invoice (the detail part of the receipt), one row per line."""
    inv = d.invoices.select("invoice_id", "order_id")
    lines = d.order_details.select("order_id", "line_number", "dish_id", "quantity", "line_total")
    m = d.menu_items.select("dish_id", "dish_name")
    return inv.join(lines, "order_id").join(m, "dish_id").select(
        "invoice_id", "line_number", F.col("dish_name").alias("name"), F.col("quantity").alias("qty"), "line_total"
    )


def receipts(d: Domain) -> DataFrame:
    """Master/detail documents: invoice header + sorted items[] + payments[] per invoice."""
    items = receipt_items(d).groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("line_number", "name", "qty", "line_total"))).alias("items")
    )
    pays = split_payments(d).groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "payment_method", "amount"))).alias("payments")
    )
    head = d.invoices.join(d.dine_orders.select("order_id", "table_id"), "order_id")
    return head.join(items, "invoice_id", "left").join(pays, "invoice_id", "left")


def receipt_texts(d: Domain) -> DataFrame:
    """The receipt of every invoice with its items and payments as text lines, in the order of the bill."""
    doc = receipts(d)
    c = d.customers.select("customer_id", "customer_name")
    named = doc.where(F.col("customer_id").isNotNull()).join(c, "customer_id", "left")
    walk_ins = doc.where(F.col("customer_id").isNull()).withColumn("customer_name", F.lit(None).cast("string"))
    item = F.transform("items", lambda i: F.concat(i["name"], F.lit(" x "), i["qty"].cast("string"), F.lit(" = "), i["line_total"].cast(MONEY_SUM).cast("string")))
    paid = F.transform("payments", lambda p: F.concat(p["payment_method"], F.lit(" "), p["amount"].cast("string")))
    return named.unionByName(walk_ins).select(
        "invoice_id", "table_id", F.date_format("payment_date", "yyyy-MM-dd").alias("payment_date"),
        F.coalesce(F.when(F.col("customer_name") != "", F.col("customer_name")), F.lit("Walk-in Guest")).alias("customer_name"),
        "sub_total", "discount_amount", "service_charge", "tax_amount", "total_amount", "status",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("item_count"),
        F.coalesce(F.array_join(item, "; "), F.lit("")).alias("items"), F.array_join(paid, "; ").alias("payments"),
    )


# ------------------------------------------------------------------------ D21
def receipt_change(d: Domain) -> DataFrame:
    """Paid = Σ payments, change = max(0, paid - total) per invoice."""
    paid = d.payments.groupBy("invoice_id").agg(F.sum("amount").cast(MONEY_SUM).alias("paid"))
    inv = d.invoices.select("invoice_id", "total_amount")
    j = inv.join(paid, "invoice_id", "left")
    paid_c = F.coalesce("paid", F.col("total_amount")).cast(MONEY_SUM)
    return j.select(
        "invoice_id", "total_amount", paid_c.alias("paid"),
        F.greatest(F.lit(0).cast(MONEY_SUM), paid_c - F.col("total_amount")).cast(MONEY_SUM).alias("change"),
    )


# ------------------------------------------------------------------------ L5
def active_order_lines(d: Domain) -> DataFrame:
    """For every table, the lines of its latest active order (no rows when none)."""
    active = d.dine_orders.where(F.col("status").isin(*ACTIVE_ORDER))
    latest = latest_order_per_table(active).select("table_id", "order_id", "customer_id")
    lines = d.order_details.select("order_id", "line_number", "dish_id", "unit_price", "quantity")
    m = d.menu_items.select("dish_id", "dish_name")
    return latest.join(lines, "order_id").join(m, "dish_id").select(
        "table_id", "order_id", "customer_id", "line_number",
        F.col("dish_id").alias("id"), F.col("dish_name").alias("name"),
        F.col("unit_price").alias("price"), F.col("quantity").alias("qty"),
    )


# ------------------------------------------------------------------------ G2
def payment_methods(d: Domain) -> DataFrame:
    """Distinct payment-method labels per invoice (unknown -> Cash), one row each."""
    p = d.payments.select("invoice_id", payment_label(F.col("method")).alias("method_label"))
    return p.distinct()
