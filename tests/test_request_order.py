"""Batches with repeated requests, long chains of sign-ups, and the order triggers (hand-written fixtures)."""

from __future__ import annotations

from decimal import Decimal as D

from tests.test_edge_cases import ts
from tests.conftest import make_domain

ORDERS = "order_id long, table_id long, customer_id long, staff_id long, order_time timestamp_ntz, status string, order_day timestamp_ntz"


def _orders(spark, *rows):
    return spark.createDataFrame([(o, t, c, 0, ts(at), s, ts("2024-01-01 00:00:00")) for o, t, c, at, s in rows], ORDERS)


def test_long_chain_of_signups_is_one_component(spark):
    from tavola.operators.jobs import contact_components, duplicate_contacts_sequential

    n = 130  # request k shares its phone with k + 1 (k even) or its email (k odd)
    rows = [(k, f"G{k}", f"09{k // 2:08d}", f"g{(k + 1) // 2}@x") for k in range(n)]
    req = spark.createDataFrame(rows, "request_id long, name string, phone string, email string")
    labels = {r.component for r in contact_components(req).collect()}
    assert labels == {0}
    customers = spark.createDataFrame([], "phone_number string, email string")
    got = {r.request_id: r.outcome for r in duplicate_contacts_sequential(make_domain(spark, customers=customers), req).collect()}
    phones, emails, want = set(), set(), {}
    for k, _, phone, email in rows:
        ok = phone not in phones and email not in emails
        want[k] = "accepted" if ok else "duplicate_in_batch"
        if ok:
            phones.add(phone)
            emails.add(email)
    assert got == want


def test_second_invoice_request_of_an_order_finds_the_first(spark):
    from tavola.operators.jobs import invoice_batch

    orders = _orders(spark, (1, 1, 7, "2024-01-01 12:00:00", "served"), (2, 1, None, "2024-01-01 13:00:00", "open"))
    totals = spark.createDataFrame([(1, D("100.00"), 1), (2, D("10.00"), 1)], "order_id long, sub_total decimal(18,2), line_count long")
    existing = spark.createDataFrame([], "invoice_id long, order_id long")
    req = spark.createDataFrame(
        [(5, 1, "cash", D("0.00")), (6, 2, "card", D("0.00")), (7, 1, "card", D("0.00")), (8, 1, "card", D("0.00"))],
        "request_id long, order_id long, payment_method string, discount_pct decimal(5,2)",
    )
    got = {r.request_id: (r.outcome, r.invoice_id) for r in invoice_batch(make_domain(spark, dine_orders=orders, order_totals=totals, invoices=existing), req).collect()}
    assert got == {5: ("created", 1), 6: ("created", 2), 7: ("exists", -1), 8: ("exists", -1)}


def test_checkouts_of_one_table_take_its_orders_newest_first(spark):
    from tavola.operators.jobs import checkout_batch

    orders = _orders(spark, (1, 3, 7, "2024-01-01 11:00:00", "served"), (2, 3, 8, "2024-01-01 12:00:00", "open"))
    totals = spark.createDataFrame([(1, D("10.00"), 1), (2, D("100.00"), 1)], "order_id long, sub_total decimal(18,2), line_count long")
    pay = "array<struct<method:string,amount:decimal(10,2)>>"
    zero = D("0.00")
    req = spark.createDataFrame(
        [(1, 3, None, [("cash", D("50.00"))], zero, zero),   # too little for order 2: nothing changes
         (2, 3, None, [("cash", D("108.00"))], zero, zero),  # closes order 2
         (3, 3, None, [("cash", D("10.80"))], zero, zero),   # closes order 1
         (4, 3, None, [("cash", D("99.00"))], zero, zero)],  # no order left
        f"request_id long, table_id long, customer_id long, payments {pay}, discount_amount decimal(18,2), service_charge decimal(18,2)",
    )
    got = {r.request_id: (r.outcome, r.order_id) for r in checkout_batch(make_domain(spark, dine_orders=orders, order_totals=totals), req).collect()}
    assert got == {1: ("insufficient", 2), 2: ("paid", 2), 3: ("paid", 1), 4: ("no_active_order", None)}


def test_only_inserts_occupy_and_only_updates_free_a_table(spark):
    from tavola.operators.changes import table_events

    rows = [
        (1, 10, "click", "08:00"),     # inserted as open: occupies
        (2, 10, "purchase", "09:00"),  # open -> closed: frees
        (3, 10, "click", "10:00"),     # reopened: an update, no effect
        (4, 10, "error", "11:00"),     # open -> cancelled: frees
        (5, 11, "purchase", "08:30"),  # inserted as closed: no effect
        (6, 11, "error", "09:30"),     # closed -> cancelled: no effect
    ]
    events = spark.createDataFrame([(i, u, e, ts(f"2024-01-01 {at}:00")) for i, u, e, at in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz")
    from pyspark.sql import functions as F

    got = {r.seq: r.new_status for r in table_events(make_domain(spark), events, F.lit(5)).collect()}
    assert got == {1: "occupied", 2: "available", 4: "available"}
