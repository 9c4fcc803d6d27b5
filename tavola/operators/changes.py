"""Change-driven rules (the reference's triggers) as batch jobs over a change feed.

The streaming versions live in ``tavola.streaming``; each has the batch twin
below, which is also what the tests compare the streams with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.operators.sequence import keyed_lag
from tavola.sources.domain import Domain

# Event type of the feed -> order status (the guest's order is keyed by user_id);
# signup events are reservation inserts.
ORDER_EVENT_STATUS = {"click": "open", "view": "preparing", "purchase": "closed", "error": "cancelled"}
TERMINAL = ["closed", "cancelled"]


def order_event_status(event_type: Column) -> Column:
    expr = None
    for k, v in ORDER_EVENT_STATUS.items():
        expr = F.when(event_type == k, v) if expr is None else expr.when(event_type == k, v)
    return expr


def table_effect(order_status: Column, previous: Column) -> Column:
    """Trigger rules: an order *inserted* as open (no status before) occupies its table; an *update* into
    closed / cancelled from neither frees it; anything else (a reopened order, an order inserted as
    closed) leaves the table alone."""
    return (
        F.when((order_status == "open") & previous.isNull(), F.lit("occupied"))
        .when(order_status.isin(*TERMINAL) & previous.isNotNull() & ~previous.isin(*TERMINAL), F.lit("available"))
    )


def order_feed(d: Domain, events: DataFrame | None = None, table_count=None) -> DataFrame:
    """Order status changes: (order_key, table_id, changed_at, seq, order_status, changed_by)."""
    e = events if events is not None else d.raw("events")
    n = table_count if table_count is not None else d.table_count()
    return e.where(F.col("event_type").isin(*ORDER_EVENT_STATUS)).select(
        F.col("user_id").alias("order_key"),
        (F.col("user_id") % n).alias("table_id"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("seq"),
        order_event_status(F.col("event_type")).alias("order_status"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("changed_by"),
    )


def table_events(d: Domain, events: DataFrame | None = None, table_count=None) -> DataFrame:
    """Table status changes: (table_id, changed_at, seq, new_status, changed_by).

    Order events need the order's previous status (a distributed per-order lag);
    reservation inserts always set the table to reserved.
    """
    e = events if events is not None else d.raw("events")
    n = table_count if table_count is not None else d.table_count()
    feed = order_feed(d, e, n)
    prev = keyed_lag(feed, ["order_key"], [F.col("changed_at"), F.col("seq")], "order_status", "_prev")
    orders = prev.select(
        "table_id", "changed_at", "seq", table_effect(F.col("order_status"), F.col("_prev")).alias("new_status"),
        "changed_by",
    ).where(F.col("new_status").isNotNull())
    reservations = e.where(F.col("event_type") == "signup").select(
        (F.col("user_id") % n).alias("table_id"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("seq"),
        F.lit("reserved").alias("new_status"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("changed_by"),
    )
    return orders.unionByName(reservations)


# ------------------------------------------------------------------------ I1
def table_state(d: Domain) -> DataFrame:
    """Status of every table after applying the feed: last event by (ts, seq), else the stored status."""
    last = table_events(d).groupBy("table_id").agg(
        F.max_by(F.struct("new_status", "changed_at"), F.struct("changed_at", "seq")).alias("l")
    )
    t = d.dining_tables.select("table_id", F.lower("status").alias("initial_status"))
    return t.join(last, "table_id", "left").select(
        "table_id",
        F.coalesce(F.col("l.new_status"), F.col("initial_status")).alias("status"),
        F.col("l.changed_at").alias("last_changed_at"),
    )


# ---------------------------------------------------------------- I2 / E5
def status_log(d: Domain) -> DataFrame:
    """One log row per real change (old != new); the first event compares with the stored status."""
    ev = table_events(d)
    prev = keyed_lag(ev, ["table_id"], [F.col("changed_at"), F.col("seq")], "new_status", "old_status")
    t = d.dining_tables.select("table_id", F.lower("status").alias("initial_status"))
    j = prev.join(t, "table_id", "left").withColumn("old_status", F.coalesce("old_status", "initial_status"))
    return j.where(~F.col("old_status").eqNullSafe(F.col("new_status"))).select(
        "table_id", "old_status", "new_status", "changed_at", "seq", "changed_by"
    )


# ------------------------------------------------------------------------ I3
def reservation_completed(d: Domain) -> DataFrame:
    """Reservations whose order reached 'closed': they become completed (cancelled ones too)."""
    closed = d.dine_orders.where((F.col("status") == "closed") & F.col("reservation_ref").isNotNull()).select(
        F.col("reservation_ref").alias("reservation_id")
    ).distinct()
    r = d.reservations.select("reservation_id", F.col("status").alias("old_status"))
    return r.join(closed, "reservation_id", "left_semi").select(
        "reservation_id", "old_status", F.lit("completed").alias("new_status")
    )


#: Days after which a reservation no longer waits for its order to close (bounds the state of the stream).
COMPLETION_DAYS = 30


def order_changes(d: Domain) -> DataFrame:
    """The order feed as a change log with both images, as the trigger sees them: (order_key, reservation_id,
    old_status, new_status, changed_at, seq).  old_status is null for an insert; an order belongs to
    its guest's first reservation."""
    feed = order_feed(d)
    log = keyed_lag(feed, ["order_key"], [F.col("changed_at"), F.col("seq")], "order_status", "old_status")
    held = d.raw("events").where(F.col("event_type") == "signup").groupBy(F.col("user_id").alias("order_key")).agg(F.min("event_id").alias("reservation_id"))
    return log.join(held, "order_key", "left").select(
        "order_key", "reservation_id", "old_status", F.col("order_status").alias("new_status"), "changed_at", "seq"
    )


def completions(changes: DataFrame, reservations: DataFrame, days: int = COMPLETION_DAYS) -> DataFrame:
    """Reservations that an order's *transition* into closed completes, whatever their status.

    An order that was closed already, or came in as closed, completes nothing; neither does one whose reservation was
    made later or more than ``days`` days before.  ``changes`` has the time ``closed_at`` and ``reservations``
    the time ``made_at`` as TIMESTAMP; the time bounds let a stream forget both sides.
    """
    closing = (F.col("new_status") == "closed") & F.col("old_status").isNotNull() & (F.col("old_status") != "closed")
    c = changes.where(closing & F.col("reservation_id").isNotNull()).select(
        F.col("reservation_id").alias("of"), "order_key", F.col("changed_at").alias("completed_at"), "closed_at"
    )
    r = reservations.select("reservation_id", F.col("status").alias("old_status"), "made_at")
    when = (F.col("closed_at") >= F.col("made_at")) & (F.col("closed_at") <= F.col("made_at") + F.expr(f"INTERVAL {days} DAY"))
    return r.join(c, (F.col("of") == F.col("reservation_id")) & when).select(
        "reservation_id", "old_status", F.lit("completed").alias("new_status"), "order_key", "completed_at"
    )


def reservation_completions(d: Domain) -> DataFrame:
    """Batch twin of ``feeds.reservation_completions_stream``."""
    changes = order_changes(d).withColumn("closed_at", instant_of(F.col("changed_at")))
    return completions(changes, d.reservations.withColumn("made_at", instant_of(F.col("created_at"))))


# ------------------------------------------------------------------------ I4
def incoming_lines(d: Domain, lines: DataFrame | None = None) -> DataFrame:
    """Order lines as submitted: price missing (NULL) on returned lines, 0 on first lines of flag A."""
    li = lines if lines is not None else d.order_details
    price = (
        F.when(F.col("return_flag") == "R", F.lit(None).cast("decimal(10,2)"))
        .when((F.col("return_flag") == "A") & (F.col("line_number") == 1), F.lit(0).cast("decimal(10,2)"))
        .otherwise(F.col("unit_price"))
    )
    return li.select("order_id", "line_number", "dish_id", "quantity", price.alias("unit_price"))


def apply_price_snapshot(lines: DataFrame, menu: DataFrame) -> DataFrame:
    m = menu.select("dish_id", F.col("price").alias("_menu_price"))
    j = lines.join(m, "dish_id", "left")
    missing = F.col("unit_price").isNull() | (F.col("unit_price") == 0)
    return j.select(
        "order_id", "line_number", "dish_id", "quantity",
        F.when(missing, F.col("_menu_price")).otherwise(F.col("unit_price")).cast("decimal(10,2)").alias("unit_price"),
        missing.alias("price_from_menu"),
    )


def price_snapshot(d: Domain) -> DataFrame:
    return apply_price_snapshot(incoming_lines(d), d.menu_items)


EPOCH_NTZ = "1970-01-01 00:00:00"
DAY_MICROS = 86_400_000_000


def instant_of(ts_ntz: Column) -> Column:
    """Zone-less wall-clock time -> TIMESTAMP at that wall-clock time in UTC, whatever the session zone.

    Windows and watermarks need TIMESTAMP; going through epoch microseconds keeps
    hour/day windows aligned with the wall clock of the data.
    """
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts_ntz))


def wall_clock_of(instant: Column) -> Column:
    """Inverse of ``instant_of``: TIMESTAMP -> zone-less wall-clock time (UTC), session-zone free."""
    us = F.unix_micros(instant)
    days = F.floor(us / F.lit(DAY_MICROS))
    rest = (us - days * F.lit(DAY_MICROS)).cast("decimal(20,0)") / F.lit(1_000_000)
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(
        days.cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)")
    )


def hourly_activity(d: Domain, events: DataFrame | None = None, width: str = "1 hour") -> DataFrame:
    """Per hour (or day) of the feed: orders opened / closed / cancelled, reservations, views, total value."""
    e = events if events is not None else d.raw("events")
    return activity_aggregate(e.withColumn("ts", instant_of(F.col("ts"))).groupBy(F.window("ts", width)))


def daily_activity(d: Domain) -> DataFrame:
    return hourly_activity(d, width="1 day")


def activity_aggregate(grouped) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count(F.when(F.col("event_type") == kind, F.lit(1)))

    return grouped.agg(
        n("click").alias("orders_opened"), n("purchase").alias("orders_closed"), n("error").alias("orders_cancelled"),
        n("signup").alias("reservations"), n("view").alias("views"),
        F.round(F.sum("value"), 6).alias("total_value"),
    ).select(
        wall_clock_of(F.col("window.start")).alias("window_start"),
        wall_clock_of(F.col("window.end")).alias("window_end"),
        "orders_opened", "orders_closed", "orders_cancelled", "reservations", "views", "total_value",
    )


# ------------------------------------------------------------------------ I7
def maintenance_reject(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """Reservation requests split by the maintenance rule (the only rule of that trigger)."""
    t = d.dining_tables.select("table_id", F.lower("status").alias("table_status"))
    req = requests if requests is not None else d.reservation_requests
    j = req.join(t, "table_id", "left")
    return j.select(
        "request_id", "table_id",
        F.when(F.col("table_status") == "maintenance", "rejected").otherwise("accepted").alias("outcome"),
    )


# ------------------------------------------------------------------------ I5
def audit_diff(before: DataFrame, after: DataFrame, key: str, table_name: str, with_json: bool = True) -> DataFrame:
    """Audit rows between two snapshots: INSERT / UPDATE / DELETE with the changed columns (and JSON images)."""
    cols = [c for c in before.columns if c != key]
    b = before.select(F.col(key), F.struct(*cols).alias("_old"))
    a = after.select(F.col(key), F.struct(*cols).alias("_new"))
    j = b.join(a, key, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "INSERT")
        .when(F.col("_new").isNull(), "DELETE")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE")
    )
    changed = F.concat_ws(",", F.array_compact(F.array(*[
        F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in cols
    ])))
    out = j.where(action.isNotNull()).select(
        F.lit(table_name).alias("table_name"), action.alias("action"), F.col(key).alias("record_id"),
        F.when(action == "UPDATE", changed).alias("changed_columns"),
        *([F.to_json(f"_{side}", {"ignoreNullFields": "false"}).alias(f"{side}_value") for side in ("old", "new")] if with_json else []),
    )
    return out


def customer_audit(d: Domain) -> DataFrame:
    """Customers before vs. after the batch: updates applied, accepted sign-ups inserted, deactivated removed."""
    from tavola.operators.jobs import customer_update, duplicate_contacts

    cols = ["customer_id", "customer_name", "phone_number", "email", "loyalty_points", "is_active"]
    before = d.customers.select(*cols)
    updated = customer_update(d).select(*cols)
    kept = updated.where(F.col("is_active"))
    max_id = d.customers.select(F.max("customer_id")).scalar()
    new = duplicate_contacts(d).where(F.col("outcome") == "accepted").select(
        (max_id + F.col("request_id") + 1).alias("customer_id"),
        F.col("name").alias("customer_name"), F.col("phone").alias("phone_number"), "email",
        F.lit(0).alias("loyalty_points"), F.lit(True).alias("is_active"),
    )
    return audit_diff(before, kept.unionByName(new), "customer_id", "customers")
