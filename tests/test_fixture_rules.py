"""Remaining edge cases of FIXTURES §4, each on a few hand-written rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_domain, rows


def ts(s):
    return dt.datetime.fromisoformat(s)


ORDER_SCHEMA = ("order_id long, table_id long, customer_id long, staff_id long, order_time timestamp_ntz, "
                "status string, order_day timestamp_ntz, reservation_ref long")
TABLE_SCHEMA = "table_id long, table_number int, capacity int, location string, status string"
RES_SCHEMA = ("reservation_id long, customer_id long, table_id long, staff_id long, reserved_at timestamp_ntz, "
              "guest_count int, special_requests string, status string, created_at timestamp_ntz")
LINE_SCHEMA = ("order_id long, line_number int, dish_id long, quantity int, unit_price decimal(10,2), "
               "line_total decimal(18,2), return_flag string")
CUST_SCHEMA = ("customer_id long, customer_name string, phone_number string, email string, address string, "
               "join_date date, loyalty_points int, is_active boolean")


def order(oid, table, cust, when, status, ref=None):
    t = ts(when)
    return (oid, table, cust, 0, t, status, t.replace(hour=0, minute=0, second=0), ref)


# ------------------------------------------------------------------ K2 / K4
def test_invoice_rounding_half_up_and_skips(spark):
    from tavola.operators.jobs import invoice_batch

    orders = spark.createDataFrame(
        [order(1, 1, 7, "2024-01-01 12:00:00", "served"), order(2, 1, None, "2024-01-01 13:00:00", "open"),
         order(3, 1, 7, "2024-01-01 14:00:00", "open")], ORDER_SCHEMA)
    totals = spark.createDataFrame([(1, D("100.10"), 2), (3, D("50.00"), 1)],
                                   "order_id long, sub_total decimal(18,2), line_count long")
    existing = spark.createDataFrame([(9, 3)], "invoice_id long, order_id long")
    req = spark.createDataFrame([(1, "cash", D("5.00")), (2, "card", D("0.00")), (3, "cash", D("0.00"))],
                                "order_id long, payment_method string, discount_pct decimal(5,2)")
    d = make_domain(spark, dine_orders=orders, order_totals=totals, invoices=existing)
    got = {r.order_id: r for r in invoice_batch(d, req).collect()}
    one = got[1]
    # disc = round(5.005) = 5.01 (half up); svc = round(95.09 * 0.05 = 4.7545) = 4.75; tax = round(9.984) = 9.98
    assert (one.discount_amount, one.service_charge, one.tax_amount, one.total_amount) == (
        D("5.01"), D("4.75"), D("9.98"), D("109.82"))
    assert one.points_earned == 0 and one.outcome == "created" and one.invoice_id == 10
    assert got[2].total_amount == D("0.00") and got[2].points_earned == 0     # no lines: all-zero invoice
    assert got[3].outcome == "exists" and got[3].invoice_id == -1             # already invoiced


def test_loyalty_walk_ins_earn_nothing(spark):
    from tavola.operators.jobs import loyalty_accrual

    cust = spark.createDataFrame([(7, "A", "0900000007", None, None, None, 10, True)], CUST_SCHEMA)
    inv = spark.createDataFrame([(1, 7, D("25000.00"), "paid"), (2, None, D("99999.00"), "paid"),
                                 (3, 7, D("9999.99"), "paid"), (4, 7, D("50000.00"), "refunded")],
                                "invoice_id long, customer_id long, total_amount decimal(18,2), status string")
    d = make_domain(spark, customers=cust, invoices=inv)
    r = loyalty_accrual(d).first()
    assert (r.old_points, r.earned, r.new_points) == (10, 2, 12)  # floor(25000/10000) + floor(9999.99/10000)


# ------------------------------------------------------------ B9 / C5 / L1 / L2
def test_cancelled_order_is_not_active_but_not_closed(spark):
    from tavola.operators.views import dashboard_floor, floor_view

    tables = spark.createDataFrame([(1, 2, 4, "Main Hall", "occupied")], TABLE_SCHEMA)
    orders = spark.createDataFrame(
        [order(1, 1, 7, "2024-01-01 12:00:00", "served"), order(2, 1, 8, "2024-01-01 13:00:00", "cancelled")],
        ORDER_SCHEMA)
    cust = spark.createDataFrame([(7, "Ann", "0900000007", None, None, None, 0, True),
                                  (8, "Bob", "0900000008", None, None, None, 0, True)], CUST_SCHEMA)
    lines = spark.createDataFrame([(1, 1, 5, 1, D("10.00"), D("10.00"), "N"), (2, 1, 5, 2, D("10.00"), D("20.00"), "N")],
                                  LINE_SCHEMA)
    d = make_domain(spark, dining_tables=tables, dine_orders=orders, customers=cust, order_details=lines)
    fv = floor_view(d).first()
    assert (fv.current_customer, fv.current_total) == ("Ann", D("10.00"))       # 'active' skips the cancelled order
    df = dashboard_floor(d).first()
    assert (df.customer, df.order_total) == ("Bob", "30 VND")                    # '<> closed' keeps it


# ------------------------------------------------------------------ D4 / C3
def test_upcoming_reservation_count_zero_cases(spark):
    from tavola.operators.views import table_availability

    tables = spark.createDataFrame([(1, 2, 4, "A", "available"), (2, 3, 4, "B", "reserved"),
                                    (3, 4, 4, "C", "occupied"), (4, 5, 4, "D", "Broken")], TABLE_SCHEMA)
    res = spark.createDataFrame(
        [(1, 1, 2, 0, ts("2024-01-01 10:00:00"), 2, None, "confirmed", ts("2024-01-01 00:00:00")),   # past
         (2, 1, 3, 0, ts("2024-02-01 10:00:00"), 2, None, "cancelled", ts("2024-01-01 00:00:00")),   # cancelled
         (3, 1, 3, 0, ts("2024-02-02 10:00:00"), 2, None, "pending", ts("2024-01-01 00:00:00"))],
        RES_SCHEMA)
    d = make_domain(spark, dining_tables=tables, reservations=res)
    got = {r.table_id: (r.upcoming_reservations, r.status_description) for r in table_availability(d).collect()}
    assert got == {1: (0, "Ready for seating"), 2: (0, "Has upcoming booking"), 3: (1, "Currently in use"),
                   4: (0, None)}


# ------------------------------------------------------------------ D5
def test_walk_in_spend_does_not_count_for_activity(spark):
    from tavola.operators.views import customer_activity

    cust = spark.createDataFrame([(7, "Ann", "0900000007", None, None, None, 0, True)], CUST_SCHEMA)
    res = spark.createDataFrame([(30, 7, 1, 0, ts("2024-01-05 19:00:00"), 2, None, "completed", ts("2024-01-01 00:00:00"))],
                                RES_SCHEMA)
    orders = spark.createDataFrame(
        [order(90, 1, 7, "2024-01-05 19:10:00", "closed", ref=30),      # through the reservation
         order(91, 1, 7, "2024-01-06 12:00:00", "closed", ref=999)],    # walk-in: reservation does not exist
        ORDER_SCHEMA)
    inv = spark.createDataFrame(
        [(90, 90, 7, D("3000000.00"), dt.date(2024, 1, 5), "paid"), (91, 91, 7, D("9000000.00"), dt.date(2024, 1, 6), "paid")],
        "invoice_id long, order_id long, customer_id long, total_amount decimal(18,2), payment_date date, status string")
    d = make_domain(spark, customers=cust, reservations=res, dine_orders=orders, invoices=inv)
    r = customer_activity(d).first()
    assert (r.total_reservations, r.total_invoices, r.total_spent, r.membership_tier) == (1, 1, D("3000000.00"), "Silver")


# ------------------------------------------------------------------ A3
def test_defaults_and_mixed_case_statuses(spark):
    from tavola.operators.defaults import apply_defaults

    res = spark.createDataFrame([(1, 1, 1, 0, ts("2024-01-01 10:00:00"), 2, None, "Confirmed", ts("2024-01-01 00:00:00")),
                                 (2, 1, 1, 0, ts("2024-01-01 10:00:00"), 2, None, None, ts("2024-01-01 00:00:00"))],
                                RES_SCHEMA)
    got = sorted(r.status for r in apply_defaults(res, "reservations").collect())
    assert got == ["confirmed", "pending"]


# ------------------------------------------------------------------ K6
def test_category_match_ignores_case_and_trailing_blanks(spark):
    from tavola.operators.jobs import menu_upsert

    cats = spark.createDataFrame([(1, "Soup", None), (2, "Drink", None)], "category_id long, category_name string, description string")
    req = spark.createDataFrame([(1, 10, "soup"), (2, 11, "DRINK "), (3, 12, "Dessert"), (4, 13, "dessert")],
                                "request_id long, dish_id long, category string")
    d = make_domain(spark, categories=cats)
    got = {r.request_id: (r.category_id, r.new_category) for r in menu_upsert(d, req).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (3, True)}  # one new category for both spellings


# ------------------------------------------------------------------ K8
def test_delete_guard(spark):
    from tavola.operators.jobs import guarded_delete

    menu = spark.createDataFrame([(1,), (2,)], "dish_id long")
    lines = spark.createDataFrame([(1, 1, 1, 1, D("1.00"), D("1.00"), "N")], LINE_SCHEMA)
    d = make_domain(spark, menu_items=menu, order_details=lines)
    req = spark.createDataFrame([(1,), (2,), (3,)], "dish_id long")
    got = {r.dish_id: r.outcome for r in guarded_delete(d, req).collect()}
    assert got == {1: "rejected_referenced", 2: "deleted", 3: "not_found"}


# ------------------------------------------------------------------ I1 / I3
def test_cancelled_then_closed_does_not_free_the_table_again(spark):
    from tavola.operators.changes import table_events

    ev = spark.createDataFrame(
        [(1, ts("2024-01-01 12:00:00"), 3, "click", 1.0, None),      # open -> occupied
         (2, ts("2024-01-01 12:30:00"), 3, "error", 1.0, None),      # cancelled -> available
         (3, ts("2024-01-01 13:00:00"), 8, "signup", 1.0, None),     # reservation on table 3 -> reserved
         (4, ts("2024-01-01 13:30:00"), 3, "purchase", 1.0, None)],  # cancelled -> closed: table unchanged
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    d = make_domain(spark)
    got = rows(table_events(d, ev, F.lit(5)), "seq", "table_id", "new_status")
    assert got == [(1, 3, "occupied"), (2, 3, "available"), (3, 3, "reserved")]


def test_reservation_completed_also_from_cancelled(spark):
    from tavola.operators.changes import reservation_completed

    orders = spark.createDataFrame([order(1, 1, 7, "2024-01-01 12:00:00", "closed", ref=30),
                                    order(2, 1, 7, "2024-01-01 12:00:00", "cancelled", ref=31)], ORDER_SCHEMA)
    res = spark.createDataFrame([(30, 7, 1, 0, ts("2024-01-01 11:00:00"), 2, None, "cancelled", ts("2024-01-01 00:00:00")),
                                 (31, 7, 1, 0, ts("2024-01-01 11:00:00"), 2, None, "confirmed", ts("2024-01-01 00:00:00"))],
                                RES_SCHEMA)
    d = make_domain(spark, dine_orders=orders, reservations=res)
    assert rows(reservation_completed(d)) == [(30, "cancelled", "completed")]


# ------------------------------------------------------------------ I4
@pytest.mark.parametrize("flag,line,price,want", [("R", 2, "7.00", "12.50"), ("A", 1, "7.00", "12.50"),
                                                  ("N", 1, "7.00", "7.00")])
def test_price_snapshot(spark, flag, line, price, want):
    from tavola.operators.changes import price_snapshot

    menu = spark.createDataFrame([(5, D("12.50"))], "dish_id long, price decimal(10,2)")
    lines = spark.createDataFrame([(1, line, 5, 2, D(price), D(price) * 2, flag)], LINE_SCHEMA)
    d = make_domain(spark, menu_items=menu, order_details=lines)
    r = price_snapshot(d).first()
    assert r.unit_price == D(want)
    assert r.price_from_menu == (want != price)


# ------------------------------------------------------------------ K7 + K9
def test_customer_update_refuses_duplicate_contacts(spark):
    from tavola.operators.jobs import customer_update

    cust = spark.createDataFrame([(1, "A", "0900000001", "a@x", None, None, 0, True),
                                  (2, "B", "0900000002", "b@x", None, None, 0, True)], CUST_SCHEMA)
    req = spark.createDataFrame(
        [(10, 1, None, "0900000002", None, None, 5, None),   # phone of customer 2: refused whole (points too)
         (11, 2, "Bee", None, "new@x", None, None, None),    # first claim of new@x: applied
         (12, 1, None, None, "new@x", None, None, None),     # new@x already claimed by customer 2: refused
         (13, 1, None, None, "a@x", None, 9, None)],         # own email again: fine
        "request_id long, customer_id long, name string, phone string, email string, address string, "
        "points int, is_active boolean")
    d = make_domain(spark, customers=cust)
    got = {r.customer_id: (r.customer_name, r.phone_number, r.email, r.loyalty_points, r.updates_applied)
           for r in customer_update(d, req).collect()}
    assert got == {1: ("A", "0900000001", "a@x", 9, 1), 2: ("Bee", "0900000002", "new@x", 0, 1)}
