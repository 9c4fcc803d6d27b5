"""Write-side rules re-aimed as set-based jobs.

Each job takes a batch of requests plus the current tables and returns one
result row per request (or a new snapshot).  Nothing is mutated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.scalar import MONEY_SUM, dec, format_vnd, invoice_amounts
from tavola.operators.graph import components
from tavola.operators.ranking import global_rank
from tavola.operators.rounds import first_come_claims, first_come_contacts, first_come_slots
from tavola.operators.views import ACTIVE_ORDER, latest_order_per_table
from tavola.sources.domain import Domain

# Reference messages and limits.
CONFLICT_MINUTES = 120
MSG_CAPACITY = "Reservation failed: Guest count exceeds table capacity."
MSG_CONFLICT = "Reservation failed: Table is already booked for this time slot."
MSG_MAINTENANCE = "Cannot reserve a table that is under maintenance"
MSG_UNKNOWN_TABLE = "Reservation failed: table does not exist."
MSG_RESERVED = "Reservation successfully created."
MSG_INVOICE_EXISTS = "Invoice already exists for this order"
CHECKOUT_TAX = "0.08"
CHECKOUT_TOLERANCE = "0.01"
POINTS_PER_INVOICE_DIVISOR = 10000  # invoice procedure: floor(total / 10,000)
CHECKOUT_POINTS = (50, 100000)      # checkout: int(total / 100,000 * 50)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a zone-less timestamp (no session time zone involved)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def minutes_apart(a: Column, b: Column) -> Column:
    """|TIMESTAMPDIFF(MINUTE, a, b)| (truncated toward zero, as MySQL)."""
    return F.abs(F.timestamp_diff("MINUTE", a, b))


# ------------------------------------------------------------------- C7 / K1
def conflicting_requests(requests: DataFrame, bookings: DataFrame, minutes: int = CONFLICT_MINUTES) -> DataFrame:
    """Requests with a booking on the same table less than ``minutes`` away.

    Interval join as an equi-join: time is cut into ``minutes``-wide buckets, each
    booking is offered to its own and both neighbouring buckets, each request
    probes only its own bucket.  The join key (table, bucket) spreads a busy
    table over time, and the left-semi join returns each request at most once.
    """
    width = minutes * 60
    b = bookings.select(
        F.col("table_id").alias("_bt"), F.col("reserved_at").alias("_bat"),
        F.explode(F.array(*[F.floor(epoch_seconds(F.col("reserved_at")) / width) + k for k in (-1, 0, 1)])).alias("_bb"),
    )
    r = requests.withColumn("_rb", F.floor(epoch_seconds(F.col("date_time")) / width))
    cond = (r["table_id"] == b["_bt"]) & (r["_rb"] == b["_bb"]) & (minutes_apart(b["_bat"], r["date_time"]) < minutes)
    return r.join(b, cond, "left_semi").drop("_rb")


def open_bookings(d: Domain) -> DataFrame:
    return d.reservations.where(F.lower("status").isin("pending", "confirmed")).select("table_id", "reserved_at")


def reservation_admission(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Admit each request against the stored bookings: capacity, then time conflict, then maintenance."""
    req = requests if requests is not None else d.reservation_requests
    t = d.dining_tables.select("table_id", "capacity", F.lower("status").alias("table_status"))
    conflicts = conflicting_requests(req, open_bookings(d)).select("request_id").withColumn("_conflict", F.lit(True))
    j = req.join(t, "table_id", "left").join(conflicts, "request_id", "left")
    reason = (
        F.when(F.col("capacity") < F.col("guest_count"), "capacity")
        .when(F.col("_conflict"), "conflict")
        .when(F.col("table_status") == "maintenance", "maintenance")
        .when(F.col("capacity").isNull(), "unknown_table")
    )
    return _admission_result(j, reason)


def _admission_result(j: DataFrame, reason: Column) -> DataFrame:
    j = j.withColumn("reason", reason)
    message = (
        F.when(F.col("reason") == "capacity", MSG_CAPACITY)
        .when(F.col("reason") == "conflict", MSG_CONFLICT)
        .when(F.col("reason") == "maintenance", MSG_MAINTENANCE)
        .when(F.col("reason") == "unknown_table", MSG_UNKNOWN_TABLE)
        .otherwise(MSG_RESERVED)
    )
    return j.select(
        "request_id", "customer_id", "table_id", "date_time", "guest_count",
        F.when(F.col("reason").isNull(), "confirmed").otherwise("rejected").alias("outcome"),
        "reason", message.alias("message"),
    )


WIDTH_MICROS = CONFLICT_MINUTES * 60 * 1_000_000


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def reservation_batch(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Sequential admission inside the batch: the earlier request (by request_id) wins a slot.

    Only requests that pass the capacity check on a known, non-maintenance table and meet no stored
    booking can take a slot.  Among them a request is refused when an earlier accepted one of its table
    is less than 120 minutes away; decided in rounds (``rounds.first_come_slots``), so a floor
    without a gap in its bookings is spread by table and time slice.
    """
    req = requests if requests is not None else d.reservation_requests
    t = d.dining_tables.select("table_id", "capacity", F.lower("status").alias("table_status"))
    stored_conflicts = conflicting_requests(req, open_bookings(d)).select("request_id").withColumn("_stored", F.lit(True))
    j = req.join(t, "table_id", "left").join(stored_conflicts, "request_id", "left")
    eligible = j.where((F.col("capacity") >= F.col("guest_count")) & (F.col("table_status") != "maintenance") & F.col("_stored").isNull())
    slots = eligible.select(F.col("table_id").alias("place"), epoch_micros(F.col("date_time")).alias("at"), "request_id")
    accepted = first_come_slots(slots, WIDTH_MICROS).where("granted").select("request_id").withColumn("_ok", F.lit(True))
    jj = j.join(accepted, "request_id", "left")
    reason = (
        F.when(F.col("capacity") < F.col("guest_count"), "capacity")
        .when(F.col("_stored"), "conflict")
        .when(F.col("table_status") == "maintenance", "maintenance")
        .when(F.col("capacity").isNull(), "unknown_table")
        .when(F.col("_ok"), F.lit(None).cast("string"))
        .otherwise("conflict")
    )
    return _admission_result(jj, reason)


# ------------------------------------------------------------------------ K2
def invoice_batch(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Invoice procedure for a batch of requests: bill the order's lines, unless the order has an invoice.

    Requests run in request_id order: the first one for an order creates its invoice, every
    later one finds it.  A batch without request_id has one request per order.
    """
    req = requests if requests is not None else d.invoice_requests
    if "request_id" not in req.columns:
        req = req.withColumn("request_id", F.col("order_id"))
    existing = d.invoices.select("order_id").withColumn("_exists", F.lit(True))
    o = d.dine_orders.select("order_id", "customer_id")
    first = req.groupBy("order_id").agg(F.min("request_id").alias("_first"))
    j = req.join(o, "order_id").join(existing, "order_id", "left").join(first, "order_id")
    j = j.withColumn("_exists", F.coalesce("_exists", F.col("request_id") != F.col("_first")))
    fresh = j.where(~F.col("_exists"))
    fresh = fresh.join(d.order_totals.select("order_id", "sub_total"), "order_id", "left").withColumn(
        "sub_total", F.coalesce(F.col("sub_total"), F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM)
    )
    amounts = invoice_amounts(F.col("sub_total"), F.col("discount_pct"))
    for k, v in amounts.items():
        fresh = fresh.withColumn(k, v)
    max_id = d.invoices.select(F.max("invoice_id")).scalar()
    fresh = global_rank(fresh, [F.col("request_id")], "_n", method="row_number")
    fresh = fresh.withColumn("invoice_id", F.coalesce(max_id, F.lit(0)) + F.col("_n"))
    created = fresh.select(
        "request_id", "order_id", "customer_id", F.lit("created").alias("outcome"), "invoice_id", "payment_method",
        "sub_total", "discount_amount", "service_charge", "tax_amount", "total_amount",
        F.when(F.col("customer_id").isNotNull(), F.floor(F.col("total_amount") / POINTS_PER_INVOICE_DIVISOR))
        .otherwise(F.lit(0)).cast("long").alias("points_earned"),
        F.concat(F.lit("Invoice #"), F.col("invoice_id").cast("string"), F.lit(" created. Total: "),
                 format_vnd(F.col("total_amount"))).alias("message"),
    )
    zero = F.lit(0).cast(MONEY_SUM)
    skipped = j.where(F.col("_exists")).select(
        "request_id", "order_id", "customer_id", F.lit("exists").alias("outcome"), F.lit(-1).cast("long").alias("invoice_id"),
        "payment_method", zero.alias("sub_total"), zero.alias("discount_amount"), zero.alias("service_charge"),
        zero.alias("tax_amount"), zero.alias("total_amount"), F.lit(0).cast("long").alias("points_earned"),
        F.lit(MSG_INVOICE_EXISTS).alias("message"),
    )
    return created.unionByName(skipped)


# ------------------------------------------------------------------------ K3
PAYMENT_TYPE = "array<struct<method:string,amount:decimal(10,2)>>"


def checkout_requests(d: Domain) -> DataFrame:
    """A checkout per occupied table, paying with the split payments of its current order's invoice;
    every 5th table sends the same checkout once more."""
    open_orders = d.dine_orders.where(F.col("status") != "closed")
    latest = latest_order_per_table(open_orders).select("table_id", "order_id")
    inv = d.invoices.select("order_id", "invoice_id", "discount_amount", "service_charge")
    pays = d.payments.groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("payment_id", "method", "amount"))).alias("_p")
    )
    t = d.dining_tables.where(F.lower("status") == "occupied").select("table_id")
    j = t.join(latest, "table_id", "left").join(inv, "order_id", "left").join(pays, "invoice_id", "left")
    j = j.withColumn("_again", F.explode(F.when(F.col("table_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return j.select(
        (F.col("table_id") * 2 + F.col("_again")).alias("request_id"),
        "table_id",
        F.lit(None).cast("long").alias("customer_id"),
        F.coalesce(
            F.transform("_p", lambda p: F.struct(p["method"].alias("method"), p["amount"].alias("amount"))),
            F.array().cast(PAYMENT_TYPE),
        ).cast(PAYMENT_TYPE).alias("payments"),
        F.coalesce("discount_amount", F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM).alias("discount_amount"),
        F.coalesce("service_charge", F.lit(0).cast(MONEY_SUM)).cast(MONEY_SUM).alias("service_charge"),
    )


def _settled(j: DataFrame) -> DataFrame:
    """Amounts and outcome of checkouts joined to an order (order_id, order_customer, sub_total)."""
    sub = F.coalesce(F.col("sub_total"), F.lit(0).cast(MONEY_SUM))
    tax = sub * dec(CHECKOUT_TAX)
    total = sub + tax + F.col("service_charge") - F.col("discount_amount")
    paid = F.aggregate("payments", F.lit(0).cast("decimal(20,2)"), lambda acc, p: (acc + p["amount"]).cast("decimal(20,2)"))
    # largest payment, first one on ties: sort by (-amount, position)
    indexed = F.transform("payments", lambda p, i: F.struct((-p["amount"]).alias("neg"), i.alias("pos"), F.lower(p["method"]).alias("m")))
    primary = F.when(F.size("payments") > 0, F.array_sort(indexed)[0]["m"]).otherwise(F.lit("cash"))
    customer = F.coalesce(F.col("customer_id"), F.col("order_customer"))
    outcome = (
        F.when(F.col("order_id").isNull(), "no_active_order")
        .when(sub == 0, "empty")
        .when(paid < total - dec(CHECKOUT_TOLERANCE), "insufficient")
        .otherwise("paid")
    )
    pts_num, pts_den = CHECKOUT_POINTS
    points = F.when(
        (outcome == "paid") & customer.isNotNull(),
        F.floor(total.cast("double") / pts_den * pts_num),
    ).otherwise(F.lit(0))
    return j.select(
        "request_id", "table_id", "order_id", customer.alias("customer_id"),
        sub.cast(MONEY_SUM).alias("sub_total"),
        F.round(tax, 2).cast(MONEY_SUM).alias("tax_amount"),
        "discount_amount", "service_charge",
        F.round(total, 2).cast(MONEY_SUM).alias("total_amount"),
        paid.cast(MONEY_SUM).alias("paid"),
        primary.alias("primary_method"),
        outcome.alias("outcome"),
        F.greatest(points, F.lit(0)).cast("long").alias("points_earned"),
    )


def checkout_batch(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Checkout settlement: 8 % tax on the subtotal, payment check with 0.01 tolerance, primary method.

    Requests on a table run in request_id order.  Each settles the table's newest order that is not
    closed; a paid one closes it, so the next request meets the order before; a refused one changes nothing.

    Decided in rounds over all tables at once: every open request meets its table's current order, the
    requests up to the first that pays are decided, and the others move on to the next order.  There are
    as many rounds as the table with most paid requests of the batch has of them, plus one.
    """
    from tavola.session import ensure_checkpoint_dir

    req = requests if requests is not None else checkout_requests(d)
    ensure_checkpoint_dir(d.spark)
    newest = Window.partitionBy("table_id").orderBy(F.col("order_time").desc(), F.col("order_id").desc())
    orders = (
        d.dine_orders.where(F.col("status") != "closed")
        .join(req.select("table_id").distinct(), "table_id", "left_semi")
        .select("table_id", "order_id", F.col("customer_id").alias("order_customer"), F.row_number().over(newest).alias("_turn"))
        .join(d.order_totals.select("order_id", "sub_total"), "order_id", "left")
        .checkpoint()
    )
    left, done, turn = req.checkpoint(), None, 1
    while True:
        met = _settled(left.join(orders.where(F.col("_turn") == turn).drop("_turn"), "table_id", "left")).checkpoint()
        first = met.where(F.col("outcome") == "paid").groupBy("table_id").agg(F.min("request_id").alias("_first"))
        met = met.join(first, "table_id", "left")
        decided = met.where(F.col("_first").isNull() | (F.col("request_id") <= F.col("_first"))).drop("_first")
        done = decided if done is None else done.unionByName(decided)
        later = met.where(F.col("request_id") > F.col("_first")).select("request_id")
        left = left.join(later, "request_id", "left_semi").checkpoint()
        turn += 1
        if left.isEmpty():
            return done.select(
                "request_id", "table_id", "order_id", "customer_id", "sub_total", "tax_amount", "discount_amount", "service_charge",
                "total_amount", "paid", "primary_method", "outcome", "points_earned",
            )


# ------------------------------------------------------------------------ K4
def loyalty_accrual(d: Domain, rule: str = "invoice") -> DataFrame:
    """New loyalty balance per customer from the paid invoices (walk-ins earn nothing)."""
    inv = d.invoices.where((F.col("status") == "paid") & F.col("customer_id").isNotNull())
    if rule == "invoice":
        earned = F.floor(F.col("total_amount") / POINTS_PER_INVOICE_DIVISOR)
    else:
        num, den = CHECKOUT_POINTS
        earned = F.floor(F.col("total_amount").cast("double") / den * num)
    per = inv.groupBy("customer_id").agg(F.sum(earned).cast("long").alias("earned"))
    c = d.customers.select("customer_id", "loyalty_points")
    j = c.join(per, "customer_id", "left")
    e = F.coalesce(F.col("earned"), F.lit(0)).cast("long")
    return j.select("customer_id", F.col("loyalty_points").alias("old_points"), e.alias("earned"),
                    (F.col("loyalty_points") + e).cast("long").alias("new_points"))


# ------------------------------------------------------------------------ K5
def cart_upsert(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Kitchen submissions: each request replaces the cart of its table's active order (or opens one).

    Requests on a table run in request_id order: the first one on a table with
    no active order opens a new order; every later one replaces that order's
    lines and customer.  Result: one row per request, with the order it wrote
    to and whether its cart is the final one.
    """
    req = requests if requests is not None else d.order_requests
    t = d.dining_tables.select("table_id", F.lower("status").alias("table_status"))
    j = req.join(t, "table_id", "left")
    ok = j.where(F.col("table_status") == "occupied")
    active = latest_order_per_table(d.dine_orders.where(F.col("status").isin(*ACTIVE_ORDER))).select(
        "table_id", F.col("order_id").alias("active_order")
    )
    per_table = ok.groupBy("table_id").agg(F.min("request_id").alias("first_req"), F.max("request_id").alias("last_req"))
    per_table = per_table.join(active, "table_id", "left")
    need_new = per_table.where(F.col("active_order").isNull())
    max_id = d.dine_orders.select(F.max("order_id")).scalar()
    need_new = global_rank(need_new, [F.col("table_id")], "_n", method="row_number").select(
        "table_id", (F.coalesce(max_id, F.lit(0)) + F.col("_n")).alias("new_order")
    )
    targets = per_table.join(need_new, "table_id", "left").select(
        "table_id", "first_req", "last_req", F.coalesce("active_order", "new_order").alias("order_id"),
        F.col("active_order").isNull().alias("_opens"),
    )
    applied = ok.join(targets, "table_id").select(
        "request_id", "table_id", "customer_id", "order_id",
        F.lit("applied").alias("outcome"),
        (F.col("_opens") & (F.col("request_id") == F.col("first_req"))).alias("new_order"),
        (F.col("request_id") == F.col("last_req")).alias("final_cart"),
        F.size("items").cast("int").alias("item_count"),
    )
    rejected = j.where(F.col("table_status").isNull() | (F.col("table_status") != "occupied")).select(
        "request_id", "table_id", "customer_id", F.lit(None).cast("long").alias("order_id"),
        F.when(F.col("table_status").isNull(), "rejected_unknown_table").otherwise("rejected_not_occupied").alias("outcome"),
        F.lit(False).alias("new_order"), F.lit(False).alias("final_cart"),
        F.size("items").cast("int").alias("item_count"),
    )
    return applied.unionByName(rejected)


def cart_orders(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Order rows after a batch of submissions: the customer of the last one (NULL overwrites too), and
    new open orders with the staff of the submission that opened them."""
    req = requests if requests is not None else d.order_requests
    applied = cart_upsert(d, req).where(F.col("outcome") == "applied")
    final = applied.where("final_cart").select("order_id", "table_id", "customer_id")
    opened = applied.where("new_order").select("order_id", "request_id").join(req.select("request_id", F.col("staff_id").alias("_opener")), "request_id")
    known = d.dine_orders.select("order_id", "staff_id", "status")
    j = final.join(known, "order_id", "left").join(opened.drop("request_id"), "order_id", "left")
    return j.select(
        "order_id", "table_id", "customer_id", F.coalesce("staff_id", "_opener").alias("staff_id"),
        F.coalesce("status", F.lit("open")).alias("status"), F.col("status").isNull().alias("is_new"),
    )


def cart_lines(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Lines of the submitted orders: each order's old lines give way to its last cart, priced from the menu."""
    from tavola.operators.changes import apply_price_snapshot

    req = requests if requests is not None else d.order_requests
    final = cart_upsert(d, req).where("final_cart").select("request_id", "order_id")
    items = req.select("request_id", F.posexplode("items").alias("_at", "_item"))
    lines = final.join(items, "request_id").select(
        "order_id", (F.col("_at") + 1).alias("line_number"), F.col("_item.dish_id").alias("dish_id"),
        F.col("_item.quantity").alias("quantity"), F.lit(None).cast("decimal(10,2)").alias("unit_price"),
    )
    return apply_price_snapshot(lines, d.menu_items).drop("price_from_menu")


# ------------------------------------------------------------------------ K6
def category_key(name: Column) -> Column:
    """Category names compare case-, accent- and trailing-space-insensitively (the schema's collation)."""
    return F.collate(name, "UNICODE_CI_AI_RTRIM")


def menu_upsert(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Resolve each request's category by name, creating missing categories (get-or-create)."""
    req = requests if requests is not None else d.menu_upserts
    cats = d.categories.select("category_id", category_key(F.col("category_name")).alias("_k"))
    r = req.withColumn("_k", category_key(F.col("category")))
    matched = r.join(cats, "_k", "left")
    missing = matched.where(F.col("category_id").isNull())
    new_names = missing.groupBy("_k").agg(
        F.min("request_id").alias("_first"), F.min_by("category", "request_id").alias("new_name")
    )
    max_id = d.categories.select(F.max("category_id")).scalar()
    new_names = global_rank(new_names, [F.col("_first")], "_n", method="row_number").select(
        "_k", "new_name", (F.coalesce(max_id, F.lit(0)) + F.col("_n")).alias("new_id")
    )
    out = matched.join(new_names, "_k", "left")
    return out.select(
        "request_id", "dish_id", "category",
        F.coalesce("category_id", "new_id").alias("category_id"),
        F.col("category_id").isNull().alias("new_category"),
    )


# ------------------------------------------------------------------------ K7
CUSTOMER_FIELDS = [("name", "customer_name"), ("phone", "phone_number"), ("email", "email"),
                   ("address", "address"), ("points", "loyalty_points"), ("is_active", "is_active")]


def merge_partial_updates(current: DataFrame, updates: DataFrame, key: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Apply partial updates in request order: per field the last non-NULL value wins, NULL keeps the old value."""
    last = updates.groupBy(key).agg(
        *[F.max_by(src, F.when(F.col(src).isNotNull(), F.col("request_id"))).alias(f"_new_{src}") for src, _ in fields],
        F.count(F.lit(1)).alias("_updates"),
    )
    j = current.join(last, key, "left")
    cols = [F.coalesce(F.col(f"_new_{src}"), F.col(dst)).alias(dst) for src, dst in fields]
    return j.select(key, *cols, F.coalesce(F.col("_updates"), F.lit(0)).alias("updates_applied"))


CONTACT_FIELDS = [("phone", "phone_number"), ("email", "email")]


def contact_conflicts(req: DataFrame, customers: DataFrame) -> DataFrame:
    """Update requests whose new phone / email belongs to another customer at their turn (duplicate-contact
    guard, K9): a refused update blocks nobody, and a contact that an earlier update gave up is free."""
    changes = req.select("request_id", F.col("customer_id").alias("owner"), F.explode(F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(field).alias("value")) for field, _ in CONTACT_FIELDS
    ])).alias("c")).select("request_id", "owner", "c.*")
    # only existing customers change anything
    changes = changes.join(customers.select(F.col("customer_id").alias("owner")), "owner", "left_semi")
    owners = customers.select(F.col("customer_id").alias("owner"), F.explode(F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(col).alias("value")) for field, col in CONTACT_FIELDS
    ])).alias("c")).select("owner", "c.*")
    return first_come_contacts(changes, owners).where("not granted").select("request_id")


def customer_update(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Partial customer updates; an update that would duplicate a phone or email is refused whole."""
    req = requests if requests is not None else d.customer_updates
    accepted = req.join(contact_conflicts(req, d.customers), "request_id", "left_anti")
    cur = d.customers.select("customer_id", *[dst for _, dst in CUSTOMER_FIELDS])
    return merge_partial_updates(cur, accepted, "customer_id", CUSTOMER_FIELDS)


# ------------------------------------------------------------------------ K8
def guarded_delete(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Delete requests for dishes: refused when any order line references the dish."""
    req = requests if requests is not None else d.menu_items.select("dish_id")
    used = d.order_details.select("dish_id").join(req, "dish_id", "left_semi").distinct().withColumn("_used", F.lit(True))
    known = d.menu_items.select("dish_id").withColumn("_known", F.lit(True))
    j = req.join(known, "dish_id", "left").join(used, "dish_id", "left")
    return j.select(
        "dish_id",
        F.when(F.col("_known").isNull(), "not_found").when(F.col("_used"), "rejected_referenced").otherwise("deleted").alias("outcome"),
    )


# ------------------------------------------------------------------------ K9
def duplicate_contacts(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """New-customer requests vs. existing contacts and earlier requests of the batch.

    A request is a duplicate when its phone, or its (non-NULL) email, belongs to
    an existing customer, or occurred in an earlier request of the same batch.
    """
    req = requests if requests is not None else d.customer_inserts
    phones = d.customers.select(F.col("phone_number").alias("phone")).distinct().withColumn("_p", F.lit(True))
    emails = d.customers.where(F.col("email").isNotNull()).select("email").distinct().withColumn("_e", F.lit(True))
    first_phone = req.groupBy("phone").agg(F.min("request_id").alias("_fp"))
    first_email = req.where(F.col("email").isNotNull()).groupBy("email").agg(F.min("request_id").alias("_fe"))
    j = (req.join(phones, "phone", "left").join(emails, "email", "left")
         .join(first_phone, "phone", "left").join(first_email, "email", "left"))
    outcome = (
        F.when(F.col("_p") | F.col("_e"), "duplicate_existing")
        .when((F.col("request_id") != F.col("_fp")) | (F.col("_fe").isNotNull() & (F.col("request_id") != F.col("_fe"))),
              "duplicate_in_batch")
        .otherwise("accepted")
    )
    return j.select("request_id", "name", "phone", "email", outcome.alias("outcome"))


# ------------------------------------------------------------------------ K10
def table_clear(d: Domain, tables: DataFrame | None = None) -> DataFrame:
    """Setting tables to available closes every non-closed order of those tables (cancelled ones too)."""
    req = tables if tables is not None else d.dining_tables.where(F.lower("status") == "occupied").select("table_id")
    o = d.dine_orders.where(F.col("status") != "closed").select("order_id", "table_id", F.col("status").alias("old_status"))
    return o.join(req, "table_id", "left_semi").select("order_id", "table_id", "old_status", F.lit("closed").alias("new_status"))


def menu_quick_update(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Dashboard toggle: a request with availability changes only availability, else only the price."""
    req = requests if requests is not None else d.menu_quick_updates
    req = req.select(
        "request_id", "dish_id", "is_available",
        F.when(F.col("is_available").isNull(), F.col("price")).alias("price"),
    )
    cur = d.menu_items.select("dish_id", "price", "is_available")
    return merge_partial_updates(cur, req, "dish_id", [("price", "price"), ("is_available", "is_available")])


TABLE_FIELDS = [("status", "status"), ("capacity", "capacity"), ("location", "location")]


def table_update(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Partial table updates (non-NULL fields overwrite); freeing a table also closes its open orders (K10)."""
    req = requests if requests is not None else d.table_updates
    cur = d.dining_tables.select("table_id", "status", "capacity", "location")
    return merge_partial_updates(cur, req, "table_id", TABLE_FIELDS)


def table_update_closures(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Orders closed because their table was set to available (K10 applied to the update batch)."""
    req = requests if requests is not None else d.table_updates
    freed = req.where(F.lower("status") == "available").select("table_id").distinct()
    return table_clear(d, freed)


# ------------------------------------------------------------- K9 sequential
def contact_components(req: DataFrame) -> DataFrame:
    """Connected components of requests linked by a shared phone or email (min request_id as label).

    Every request is linked to the first request of its phone and of its email, so the
    links grow with the requests; components go on to the fixpoint, whatever the length of a chain.
    """
    links = None
    for field in ("phone", "email"):
        held = req.where(F.col(field).isNotNull()).select("request_id", field)
        first = held.groupBy(field).agg(F.min("request_id").alias("first"))
        own = held.join(first, field).select("request_id", "first")
        links = own if links is None else links.unionByName(own)
    found = components(links, "request_id", "first").withColumnRenamed("vertex", "request_id")
    return req.select("request_id").join(found, "request_id", "left").select(
        "request_id", F.coalesce("root", "request_id").alias("component")
    )


def duplicate_contacts_sequential(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Sign-ups processed one at a time, exactly as single inserts would be.

    Requests duplicating an existing customer are refused (and block nothing).  The others are decided in
    rounds (``rounds.first_come_claims``): each open request claims its phone and email, the first claimer of
    both wins them, and whoever claims one of them too is refused.
    """
    req = requests if requests is not None else d.customer_inserts
    phones = d.customers.select(F.col("phone_number").alias("phone")).distinct().withColumn("_p", F.lit(True))
    emails = d.customers.where(F.col("email").isNotNull()).select("email").distinct().withColumn("_e", F.lit(True))
    j = req.join(phones, "phone", "left").join(emails, "email", "left")
    existing = F.coalesce(F.col("_p"), F.lit(False)) | F.coalesce(F.col("_e"), F.lit(False))
    claims = F.array(*[F.concat(F.lit(f"{kind}:"), F.col(kind)) for kind in ("phone", "email")])
    decided = first_come_claims(j.where(~existing).select("request_id", claims.alias("claims"))).select("request_id", F.col("granted").alias("accepted"))
    out = j.join(decided, "request_id", "left")
    outcome = (
        F.when(existing, "duplicate_existing")
        .when(F.col("accepted"), "accepted")
        .otherwise("duplicate_in_batch")
    )
    return out.select("request_id", "name", "phone", "email", outcome.alias("outcome"))
