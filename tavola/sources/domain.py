"""Adapter: the driver's TPC-H-like parquet tables -> the restaurant domain.

Every domain table is a lazy DataFrame over the raw parquet files, so Catalyst
prunes columns and pushes filters down to the scan.  The same mapping is written
as a DuckDB CTE prefix in ``tavola.plans.oracle`` (kept in step by hand).

Mapping (one rule per column, deterministic):

* categories     distinct ``p_type``; id = position in name order
* menu_items     ``part``: id p_partkey, name p_name, category p_type,
                 price p_retailprice as DECIMAL(10,2), prep time p_size,
                 available unless p_partkey % 10 = 0, no description when p_partkey % 7 = 0
* customers      ``customer``: phone '09' + 8-digit key, points floor(acctbal / 5) >= 0
* staff          ``nation``: one staff member per nation key
* dining_tables  ``supplier``: capacity key % 20 + 1, location by nation, status by key
* dine_orders    ``orders``: table = key % (number of tables), 40 % walk-ins,
                 time = order date + (key % 1440) minutes, status from o_orderstatus/priority
* order_details  ``lineitem``: qty l_quantity, unit price = floor(cents(extendedprice) / qty)
* invoices       one per order with lines, amounts by the invoice-procedure formula
* payments       one payment per invoice, two (split in halves) when order key % 3 = 0
* reservations   ``events`` of type signup / purchase
"""

from __future__ import annotations

import copy
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.functions.defaults import apply_defaults

from tavola.functions.scalar import dec

# ---------------------------------------------------------------------------
# Fixed values of the domain (enum domains and mapping lists), in natural order.
# ---------------------------------------------------------------------------
TABLE_LOCATIONS = ["Main Hall", "VIP Room", "Private Room", "Banquet Hall", "Outdoor"]
TABLE_STATUSES = ["available", "reserved", "occupied", "maintenance"]
ORDER_STATUSES = ["open", "preparing", "served", "closed", "cancelled"]
RESERVATION_STATUSES = ["pending", "confirmed", "cancelled", "completed"]
PAYMENT_METHODS = ["cash", "card", "bank_transfer", "ewallet"]
INVOICE_STATUSES = ["unpaid", "paid", "refunded"]
STAFF_ROLES = ["admin", "manager", "cashier", "waiter", "chef"]

# Invoice procedure rates (service 5 %, tax 10 %) and the seed/report rates.
SERVICE_RATE = "0.05"
TAX_RATE = "0.10"

MONEY = "decimal(10,2)"
MONEY_SUM = "decimal(18,2)"

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def pick(values: list[str], index: Column) -> Column:
    """values[index] for a 0-based integer column, as a CASE expression."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def minutes(col: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), col.cast("int"), F.lit(0))


def loaded(build):
    """A table of the adapter with its statuses in lower case and the schema's defaults (but no made-up dates)."""

    def normalised(self) -> DataFrame:
        return apply_defaults(build(self), build.__name__, as_of=None)

    normalised.__name__, normalised.__doc__ = build.__name__, build.__doc__
    return cached_property(normalised)


class Domain:
    """Lazily built domain tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def with_tables(self, **tables: DataFrame) -> Domain:
        """The same domain with some tables replaced, for a report over a part of them."""
        other = copy.copy(self)
        other.__dict__ = self.__dict__ | tables
        return other

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ dims
    @cached_property
    def categories(self) -> DataFrame:
        # distinct() first: the window only sees the category list (one row per
        # category name), never the part table itself.
        names = self.raw("part").select(F.col("p_type").alias("category_name")).distinct()
        return names.select(
            F.dense_rank().over(Window.orderBy("category_name")).cast("long").alias("category_id"),
            "category_name",
            F.lit(None).cast("string").alias("description"),
        )

    @cached_property
    def menu_items(self) -> DataFrame:
        p = self.raw("part")
        items = p.select(
            F.col("p_partkey").alias("dish_id"),
            F.col("p_name").alias("dish_name"),
            F.col("p_type").alias("category_name"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("description"),
            (F.col("p_partkey") % 10 != 0).alias("is_available"),
            F.col("p_size").cast("int").alias("preparation_time"),
        )
        # a handful of category names: shuffling dishes by category would make
        # every category a hot key, so the category list is broadcast (size checked)
        from tavola.operators.joins import sized_broadcast

        cats = sized_broadcast(self.categories.select("category_id", "category_name"))
        return items.join(cats, "category_name", "left").select(
            "dish_id", "category_id", "dish_name", "category_name", "price",
            "description", "is_available", "preparation_time",
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lit("09"), F.lpad(key.cast("string"), 8, "0")).alias("phone_number"),
            F.when(key % 7 == 0, F.lit(None))
            .otherwise(F.concat(F.lit("guest"), key.cast("string"), F.lit("@mail.example")))
            .alias("email"),
            F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")).alias("address"),
            F.when(key % 11 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (key % 1500).cast("int")))
            .alias("join_date"),
            F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 5)).cast("int").alias("loyalty_points"),
            (F.col("c_mktsegment") != "AUTOMOBILE").alias("is_active"),
        )

    @loaded
    def staff(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(
            F.col("n_nationkey").cast("long").alias("staff_id"),
            F.concat(F.lit("Staff "), F.col("n_name")).alias("staff_name"),
            pick(STAFF_ROLES, F.col("n_nationkey") % 5).alias("role"),
            F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit("08"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0"))).alias("phone_number"),
            (F.col("n_regionkey") * 250 + 900).cast(MONEY).alias("salary"),
        )

    @loaded
    def dining_tables(self) -> DataFrame:
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        return s.select(
            key.alias("table_id"),
            (key + 1).cast("int").alias("table_number"),
            (key % 20 + 1).cast("int").alias("capacity"),
            pick(TABLE_LOCATIONS, F.col("s_nationkey") % 5).alias("location"),
            pick(TABLE_STATUSES, key % 4).alias("status"),
        )

    def table_count(self) -> Column:
        """Number of dining tables as a scalar subquery (evaluated once per query)."""
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    # ---------------------------------------------------------------- facts
    @loaded
    def dine_orders(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        status = (
            F.when(F.col("o_orderstatus") == "F", "closed")
            .when(F.col("o_orderstatus") == "O", "open")
            .when(F.col("o_orderpriority") == "5-LOW", "cancelled")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "served")
            .otherwise("preparing")
        )
        return o.select(
            key.alias("order_id"),
            (key % self.table_count()).alias("table_id"),
            F.when(key % 5 < 2, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("customer_id"),
            (key % 25).alias("staff_id"),
            (F.col("o_orderdate") + minutes(key % 1440)).alias("order_time"),
            status.alias("status"),
            F.col("o_orderdate").alias("order_day"),
            # reservation the order refers to; it may not exist (then the order has none)
            F.expr("o_orderkey div 3").alias("reservation_ref"),
        )

    def orders_since(self, start) -> DataFrame:
        """Orders with order_time >= start.

        order_time = order_day + less than one day, so ``order_day > start - 1 day``
        is implied; it is stated too because it reaches the parquet scan.
        """
        start = F.lit(start).cast("timestamp_ntz") if not isinstance(start, Column) else start
        o = self.dine_orders
        cond = (F.col("order_day") > start - F.expr("INTERVAL 1 DAY")) & (F.col("order_time") >= start)
        if "order_month" in o.columns:  # stored layout: prune month partitions too
            cond = cond & (F.col("order_month") >= F.trunc(F.to_date(start - F.expr("INTERVAL 1 DAY")), "month"))
        return o.where(cond)

    @staticmethod
    def map_lineitem(li: DataFrame) -> DataFrame:
        """lineitem rows -> order_details rows (also used on a stream of lineitem)."""
        qty = F.col("l_quantity").cast("int")
        cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
        unit = (cents.cast("decimal(18,0)") * dec("0.01")).cast(MONEY)
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("dish_id"),
            qty.alias("quantity"),
            unit.alias("unit_price"),
            (qty.cast("decimal(10,0)") * unit).cast(MONEY_SUM).alias("line_total"),
            F.col("l_returnflag").alias("return_flag"),
        )

    @cached_property
    def order_details(self) -> DataFrame:
        return self.map_lineitem(self.raw("lineitem"))

    @cached_property
    def order_totals(self) -> DataFrame:
        """Subtotal and line count per order that has lines (one shuffle of lineitem)."""
        return self.order_details.groupBy("order_id").agg(
            F.sum("line_total").cast(MONEY_SUM).alias("sub_total"),
            F.count(F.lit(1)).alias("line_count"),
        )

    @loaded
    def invoices(self) -> DataFrame:
        from tavola.functions.scalar import invoice_amounts

        o = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey"),
            F.col("o_orderstatus"),
            F.col("o_orderdate"),
        )
        key = F.col("order_id")
        base = self.order_totals.join(o, "order_id")
        pct = (key % 4 * 5).cast("decimal(5,2)")
        amounts = invoice_amounts(F.col("sub_total"), pct)
        return base.select(
            key.alias("invoice_id"),
            key.alias("order_id"),
            F.when(key % 5 < 2, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("customer_id"),
            F.col("sub_total"),
            amounts["discount_amount"].alias("discount_amount"),
            amounts["service_charge"].alias("service_charge"),
            amounts["tax_amount"].alias("tax_amount"),
            amounts["total_amount"].alias("total_amount"),
            pick(PAYMENT_METHODS, key % 4).alias("payment_method"),
            F.col("o_orderdate").cast("date").alias("payment_date"),
            F.when(F.col("o_orderstatus") == "F", "paid")
            .when(F.col("o_orderstatus") == "O", "unpaid")
            .otherwise("refunded")
            .alias("status"),
        )

    @loaded
    def payments(self) -> DataFrame:
        inv = self.invoices.select("invoice_id", "total_amount", "payment_method")
        key = F.col("invoice_id")
        total_cents = (F.col("total_amount") * 100).cast("long")
        first_cents = F.floor(total_cents / F.lit(2)).cast("long")
        split = key % 3 == 0
        one = F.struct(F.lit(0).alias("seq"), F.col("total_amount").alias("amount"), F.col("payment_method").alias("method"))
        first = F.struct(
            F.lit(0).alias("seq"),
            (first_cents.cast("decimal(18,0)") * dec("0.01")).cast(MONEY).alias("amount"),
            F.col("payment_method").alias("method"),
        )
        second = F.struct(
            F.lit(1).alias("seq"),
            ((total_cents - first_cents).cast("decimal(18,0)") * dec("0.01")).cast(MONEY).alias("amount"),
            pick(PAYMENT_METHODS, (key + 1) % 4).alias("method"),
        )
        rows = inv.select("invoice_id", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(one))).alias("p"))
        return rows.select(
            (F.col("invoice_id") * 2 + F.col("p.seq")).alias("payment_id"),
            "invoice_id",
            F.col("p.amount").alias("amount"),
            F.col("p.method").alias("method"),
        )

    @loaded
    def reservations(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("signup", "purchase"))
        eid, uid = F.col("event_id"), F.col("user_id")
        return e.select(
            eid.alias("reservation_id"),
            uid.alias("customer_id"),
            ((eid * 31 + uid) % self.table_count()).alias("table_id"),
            (eid % 30).alias("staff_id"),
            F.col("ts").alias("reserved_at"),
            (F.floor(F.col("value")).cast("int") % 8 + 1).alias("guest_count"),
            F.when(F.col("event_type") == "purchase", F.col("props")).alias("special_requests"),
            pick(RESERVATION_STATUSES, (eid + uid) % 4).alias("status"),
            (F.col("ts") - F.make_dt_interval(F.lit(0), (eid % 72).cast("int"), F.lit(0), F.lit(0))).alias("created_at"),
        )

    # ------------------------------------------------------- request batches
    # The set-based jobs take a batch of requests; these batches are derived
    # from the driver tables too, so their size grows with the data.
    def part_count(self) -> Column:
        return self.raw("part").select(F.count(F.lit(1))).scalar()

    @staticmethod
    def map_view_requests(e: DataFrame, table_count) -> DataFrame:
        """events of type view -> reservation requests (also used on a stream of events)."""
        eid, uid = F.col("event_id"), F.col("user_id")
        return e.where(F.col("event_type") == "view").select(
            eid.alias("request_id"),
            uid.alias("customer_id"),
            ((eid * 7 + uid) % table_count).alias("table_id"),
            (eid % 25).alias("staff_id"),
            F.col("ts").alias("date_time"),
            (F.floor(F.col("value")).cast("int") % 10 + 1).alias("guest_count"),
        )

    @cached_property
    def reservation_requests(self) -> DataFrame:
        """Booking attempts: ``events`` of type view."""
        return self.map_view_requests(self.raw("events"), self.table_count())

    @cached_property
    def invoice_requests(self) -> DataFrame:
        """A billing request per order, a second one for every 50th; discount from the customer's loyalty
        points (walk-ins: 0).  Orders without a customer stay out of the join."""
        from tavola.functions.scalar import discount_pct

        o = self.dine_orders.select(
            "order_id", "customer_id",
            F.explode(F.when(F.col("order_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        )
        c = self.customers.select("customer_id", "loyalty_points")
        known = o.where(F.col("customer_id").isNotNull()).join(c, "customer_id", "left")
        walk_ins = o.where(F.col("customer_id").isNull()).withColumn("loyalty_points", F.lit(None).cast("int"))
        return known.unionByName(walk_ins).select(
            (F.col("order_id") * 2 + F.col("again")).alias("request_id"),
            "order_id",
            pick(PAYMENT_METHODS, (F.col("order_id") + 2) % 4).alias("payment_method"),
            F.when(F.col("loyalty_points").isNull(), dec("0.00"))
            .otherwise(discount_pct(F.col("loyalty_points"))).cast("decimal(5,2)").alias("discount_pct"),
        )

    @cached_property
    def order_requests(self) -> DataFrame:
        """Cart submissions: ``events`` of type click, one or two items (none every 17th)."""
        e = self.raw("events").where(F.col("event_type") == "click")
        eid, uid = F.col("event_id"), F.col("user_id")
        m = self.part_count()
        first = F.struct(((eid * 13) % m).alias("dish_id"), (F.floor(F.col("value")).cast("int") % 3 + 1).alias("quantity"))
        second = F.struct(((eid * 13 + 7) % m).alias("dish_id"), F.lit(1).alias("quantity"))
        items = (
            F.when(eid % 17 == 0, F.array().cast("array<struct<dish_id:bigint,quantity:int>>"))
            .when(eid % 2 == 0, F.array(first, second))
            .otherwise(F.array(first))
        )
        return e.select(
            eid.alias("request_id"),
            (uid % self.table_count()).alias("table_id"),
            F.when(eid % 3 == 0, F.lit(None).cast("long")).otherwise(uid).alias("customer_id"),
            (eid % 25).alias("staff_id"),
            items.alias("items"),
        )

    @cached_property
    def menu_upserts(self) -> DataFrame:
        """Category re-assignment per dish: even keys name an existing category in lower case, odd a brand."""
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("request_id"),
            F.col("p_partkey").alias("dish_id"),
            F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_brand")).alias("category"),
        )

    @cached_property
    def menu_writes(self) -> DataFrame:
        """Menu editor requests: a new dish for every 11th part, else a partial update of some dish (NULL = leave unchanged);
        every 22nd request changes a dish that the batch itself creates."""
        p, n = self.raw("part"), self.part_count()
        key = F.col("p_partkey")
        new = key % 11 == 0
        max_id = self.raw("part").select(F.max("p_partkey")).scalar()
        target = F.when(key % 22 == 1, max_id + 1 + key % 50).otherwise((key * 7) % n)
        return p.select(
            key.alias("request_id"),
            F.when(~new, target).alias("dish_id"),
            F.when(new | (key % 4 == 0), F.concat(F.lit("Special "), F.col("p_name"))).alias("name"),
            F.when(new | (key % 3 == 0), F.when(key % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lit("Chef "), F.col("p_brand")))).alias("category"),
            F.when(new | (key % 5 == 0), (F.col("p_retailprice").cast(MONEY) + dec("1.50")).cast(MONEY)).alias("price"),
            F.when(new | (key % 7 == 0), key % 14 != 0).alias("is_available"),
            F.when((new & (key % 2 == 0)) | (key % 6 == 0), F.col("p_brand")).alias("description"),
            F.when(new | (key % 8 == 0), (F.col("p_size") + 1).cast("int")).alias("prep_time"),
        )

    @cached_property
    def customer_updates(self) -> DataFrame:
        """Partial customer updates (NULL = leave unchanged): ``events`` of type signup."""
        e = self.raw("events").where(F.col("event_type") == "signup")
        eid = F.col("event_id")
        return e.select(
            eid.alias("request_id"),
            F.col("user_id").alias("customer_id"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("phone"),
            F.when(eid % 3 == 0, F.concat(F.lit("new"), eid.cast("string"), F.lit("@mail.example"))).alias("email"),
            F.lit(None).cast("string").alias("address"),
            F.when(eid % 2 == 0, F.floor(F.col("value")).cast("int")).alias("points"),
            F.when(eid % 5 == 0, F.lit(False)).alias("is_active"),
        )

    @cached_property
    def customer_inserts(self) -> DataFrame:
        """New-customer requests: ``events`` of type error; contacts may repeat existing or earlier ones."""
        e = self.raw("events").where(F.col("event_type") == "error")
        eid = F.col("event_id")
        n = self.raw("customer").select(F.count(F.lit(1))).scalar()
        return e.select(
            eid.alias("request_id"),
            F.concat(F.lit("Guest "), eid.cast("string")).alias("name"),
            F.concat(F.lit("09"), F.lpad((eid % (n * 2)).cast("string"), 8, "0")).alias("phone"),
            F.when(eid % 4 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("guest"), (eid % (n * 3)).cast("string"), F.lit("@mail.example"))).alias("email"),
        )

    @cached_property
    def menu_quick_updates(self) -> DataFrame:
        """Dashboard menu toggles: availability for every 3rd dish, price for every 5th (both: availability wins)."""
        p = self.raw("part")
        key = F.col("p_partkey")
        return p.select(
            key.alias("request_id"),
            key.alias("dish_id"),
            F.when(key % 3 == 0, key % 2 == 0).alias("is_available"),
            F.when(key % 5 == 0, F.round(F.col("p_retailprice").cast(MONEY) * dec("1.1"), 2).cast(MONEY)).alias("price"),
        )

    @cached_property
    def table_updates(self) -> DataFrame:
        """One partial update per table: free every 3rd, resize the next, move the one after."""
        s = self.raw("supplier")
        key = F.col("s_suppkey")
        return s.select(
            key.alias("request_id"),
            key.alias("table_id"),
            F.when(key % 3 == 0, F.lit("available")).alias("status"),
            F.when(key % 3 == 1, (key % 12 + 2).cast("int")).alias("capacity"),
            F.when(key % 3 == 2, F.lit("Terrace")).alias("location"),
        )
