"""Hand-written fixtures for the edge cases of SURVEY §0.1 / FIXTURES §4."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_domain, rows

D = Decimal


def ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture(scope="module")
def menu(spark):
    return spark.createDataFrame(
        [(1, 1, "Pho", "Soup", D("50.00"), None, True, 0),
         (2, 1, "Bun", "Soup", D("40.00"), "", True, None),
         (3, 2, "Beer", "Drink", D("20.00"), "cold", True, 5),
         (4, None, "Ghost", None, D("10.00"), None, False, 7)],
        "dish_id long, category_id long, dish_name string, category_name string, price decimal(10,2), "
        "description string, is_available boolean, preparation_time int",
    )


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame([(1, "Soup", None), (2, "Drink", None)],
                                 "category_id long, category_name string, description string")


def lines(spark, data):
    return spark.createDataFrame(
        [(o, i + 1, dish, q, D(p), D(p) * q, "N") for i, (o, dish, q, p) in enumerate(data)],
        "order_id long, line_number int, dish_id long, quantity int, unit_price decimal(10,2), "
        "line_total decimal(18,2), return_flag string",
    )


# --------------------------------------------------------------------- D11
def test_pairs_self_pair_and_first_seen_ties(spark, menu, categories):
    from tavola.operators.basket import basket_pairs, pair_counts

    od = lines(spark, [(10, 1, 1, "1"), (10, 1, 1, "1"), (10, 3, 1, "1"),  # Pho, Pho, Beer
                       (11, 2, 1, "1"), (11, 3, 1, "1"),                   # Bun, Beer
                       (12, 4, 1, "1"), (12, 1, 1, "1")])                  # Ghost has no category
    d = make_domain(spark, order_details=od, menu_items=menu, categories=categories)
    got = {(r.item_1, r.item_2): r.times_ordered_together for r in pair_counts(d).collect()}
    # A,A,B counts (A,B) twice and (A,A) once; uncategorised dishes are not in the basket view
    assert got == {("Beer", "Pho"): 2, ("Pho", "Pho"): 1, ("Beer", "Bun"): 1}
    top = [(r.item_1, r.item_2) for r in basket_pairs(d).collect()]
    assert top[0] == ("Beer", "Pho")
    # ties at count 1: first seen order 10 (Pho,Pho) before order 11 (Beer,Bun)
    assert top[1:] == [("Pho", "Pho"), ("Beer", "Bun")]


# ------------------------------------------------------------------ D1 / E1
def test_rank_has_gaps_on_ties(spark):
    from tavola.operators.ranking import global_rank

    df = spark.createDataFrame([(1, 10), (2, 10), (3, 7), (4, 7), (5, 1)], "id long, q long")
    got = rows(global_rank(df, [F.col("q").desc()], "r", keys=["q"]), "id", "r")
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    dense = rows(global_rank(df, [F.col("q").desc()], "r", method="dense_rank", keys=["q"]), "id", "r")
    assert dense == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


def test_global_rank_matches_window_on_many_partitions(spark):
    from pyspark.sql import Window

    from tavola.operators.ranking import global_rank

    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") * 7919 % 97).alias("v"))
    mine = global_rank(df, [F.col("v").desc()], "r", num_partitions=13, keys=["v"])
    ref = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc())))
    assert rows(mine, "id", "r") == rows(ref, "id", "r")
    dense = global_rank(df, [F.col("v").desc()], "r", method="dense_rank", num_partitions=13, keys=["v"])
    dref = df.withColumn("r", F.dense_rank().over(Window.orderBy(F.col("v").desc())))
    assert rows(dense, "id", "r") == rows(dref, "id", "r")
    rn = global_rank(df, [F.col("v").desc(), F.col("id")], "r", method="row_number", num_partitions=13)
    rref = df.withColumn("r", F.row_number().over(Window.orderBy(F.col("v").desc(), F.col("id"))))
    assert rows(rn, "id", "r") == rows(rref, "id", "r")


def test_rank_with_one_hot_value_spreads_and_is_exact(spark):
    """A value shared by most rows (ties) is ranked from the histogram, not inside one task."""
    from pyspark.sql import Window

    from tavola.operators.ranking import global_rank

    df = spark.range(0, 4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).alias("v"))
    mine = global_rank(df, [F.col("v").desc()], "r", num_partitions=8, keys=["v"])
    ref = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc())))
    assert rows(mine, "id", "r") == rows(ref, "id", "r")


def test_keyed_lag_and_running_max_match_windows(spark):
    from pyspark.sql import Window

    from tavola.operators.sequence import keyed_lag, keyed_running_max

    # key 0 is hot: most rows, so it spans several slices
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"),
        F.col("id").alias("t"), (F.col("id") * 31 % 1000).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("t")
    ref = df.withColumn("p", F.lag("v").over(w)).withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = keyed_running_max(keyed_lag(df, ["k"], [F.col("t")], "v", "p"), ["k"], [F.col("t")], "v", "m", slice_by=F.floor(F.col("t") / 100))
    assert rows(mine, "k", "t", "p", "m") == rows(ref, "k", "t", "p", "m")


# ---------------------------------------------------------------- C7 / K1
@pytest.fixture(scope="module")
def floor(spark):
    return spark.createDataFrame(
        [(1, 2, 4, "Main Hall", "available"), (2, 3, 2, "VIP Room", "maintenance"), (3, 4, 6, None, "occupied")],
        "table_id long, table_number int, capacity int, location string, status string",
    )


def test_reservation_conflict_boundaries(spark, floor):
    from tavola.operators.jobs import reservation_admission

    booked = spark.createDataFrame(
        [(100, 9, 1, 1, ts("2024-01-10 18:00:00"), 2, None, "confirmed", ts("2024-01-01 00:00:00")),
         (101, 9, 1, 1, ts("2024-01-11 18:00:00"), 2, None, "cancelled", ts("2024-01-01 00:00:00"))],
        "reservation_id long, customer_id long, table_id long, staff_id long, reserved_at timestamp_ntz, "
        "guest_count int, special_requests string, status string, created_at timestamp_ntz",
    )
    req = spark.createDataFrame(
        [(1, 5, 1, 1, ts("2024-01-10 20:00:00"), 2),   # exactly 120 min later: allowed
         (2, 5, 1, 1, ts("2024-01-10 16:00:00"), 2),   # exactly 120 min earlier: allowed
         (3, 5, 1, 1, ts("2024-01-10 19:59:59"), 2),   # 119 min 59 s: conflict
         (4, 5, 1, 1, ts("2024-01-10 16:00:01"), 2),   # other side: conflict
         (5, 5, 1, 1, ts("2024-01-10 18:30:00"), 9),   # over capacity and conflicting: capacity
         (6, 5, 1, 1, ts("2024-01-11 18:00:00"), 2),   # only a cancelled booking there: allowed
         (7, 5, 2, 1, ts("2024-02-01 12:00:00"), 2),   # maintenance table
         (8, 5, 42, 1, ts("2024-02-01 12:00:00"), 2)], # unknown table
        "request_id long, customer_id long, table_id long, staff_id long, date_time timestamp_ntz, guest_count int",
    )
    d = make_domain(spark, reservations=booked, dining_tables=floor)
    got = {r.request_id: r.reason for r in reservation_admission(d, req).collect()}
    assert got == {1: None, 2: None, 3: "conflict", 4: "conflict", 5: "capacity", 6: None,
                   7: "maintenance", 8: "unknown_table"}


def test_reservation_batch_first_request_wins(spark, floor):
    from tavola.operators.jobs import reservation_batch

    booked = spark.createDataFrame(
        [(100, 9, 1, 1, ts("2024-01-10 18:00:00"), 2, None, "pending", ts("2024-01-01 00:00:00"))],
        "reservation_id long, customer_id long, table_id long, staff_id long, reserved_at timestamp_ntz, "
        "guest_count int, special_requests string, status string, created_at timestamp_ntz",
    )
    req = spark.createDataFrame(
        [(1, 5, 1, 1, ts("2024-01-10 21:00:00"), 2),   # free: accepted
         (2, 5, 1, 1, ts("2024-01-10 22:00:00"), 2),   # 60 min after request 1: conflict (batch)
         (3, 5, 1, 1, ts("2024-01-10 20:30:00"), 2),   # conflicts with stored 18:00? no (150 min); with 1: yes
         (4, 5, 1, 1, ts("2024-01-11 09:00:00"), 2),   # far away: accepted
         (5, 5, 1, 1, ts("2024-01-10 19:00:00"), 9)],  # capacity first
        "request_id long, customer_id long, table_id long, staff_id long, date_time timestamp_ntz, guest_count int",
    )
    d = make_domain(spark, reservations=booked, dining_tables=floor)
    got = {r.request_id: r.reason for r in reservation_batch(d, req).collect()}
    assert got == {1: None, 2: "conflict", 3: "conflict", 4: None, 5: "capacity"}


def _brute_force_batch(reqs, tables, bookings):
    """Sequential reference: one request at a time, as the stored procedure would see them."""
    taken = {}
    for b in bookings:
        taken.setdefault(b["table_id"], []).append(b["reserved_at"])
    out = {}
    for r in sorted(reqs, key=lambda x: x["request_id"]):
        t = tables.get(r["table_id"])
        cap = t["capacity"] if t else None
        if cap is not None and cap < r["guest_count"]:
            out[r["request_id"]] = "capacity"
            continue
        if any(abs((r["date_time"] - x).total_seconds()) < 7200 for x in taken.get(r["table_id"], [])):
            out[r["request_id"]] = "conflict"
            continue
        if t is None:
            out[r["request_id"]] = "unknown_table"
            continue
        if t["status"].lower() == "maintenance":
            out[r["request_id"]] = "maintenance"
            continue
        taken.setdefault(r["table_id"], []).append(r["date_time"])
        out[r["request_id"]] = None
    return out


def test_reservation_batch_matches_sequential_reference(spark, small_dir):
    from tavola.operators.jobs import open_bookings, reservation_batch
    from tavola.sources.domain import Domain

    d = Domain(spark, small_dir)
    reqs = [r.asDict() for r in d.reservation_requests.collect()]
    tables = {r.table_id: r.asDict() for r in d.dining_tables.collect()}
    bookings = [r.asDict() for r in open_bookings(d).collect()]
    want = _brute_force_batch(reqs, tables, bookings)
    got = {r.request_id: r.reason for r in reservation_batch(d).collect()}
    assert got == want
    assert sum(v is None for v in got.values()) > 0 and sum(v == "conflict" for v in got.values()) > 0


# ------------------------------------------------------------------ J1-J5
def test_scalar_rules(spark):
    from tavola.functions.scalar import discount_pct, format_vnd, points_tier, service_charge

    df = spark.createDataFrame(
        [(199, "Outdoor", "10.05", "2.50"), (200, "VIP Room", "10.00", "1234567.50"), (499, "Private Room", "1.00", "0.49"),
         (500, "Banquet Hall", "100.00", "999.5"), (999, None, "10.10", "0"), (1000, "Nowhere", "0.10", "1000000"),
         (None, "Main Hall", "3.33", "12.345")],
        "p int, loc string, sub string, amt string",
    ).select("p", "loc", F.col("sub").cast("decimal(18,2)").alias("sub"), F.col("amt").cast("decimal(18,3)").alias("amt"))
    out = df.select(
        "p", discount_pct(F.col("p")).alias("d"), points_tier(F.col("p")).alias("t"),
        service_charge(F.col("loc"), F.col("sub")).alias("s"), format_vnd(F.col("amt")).alias("v"),
    ).collect()
    got = {r.p: (r.d, r.t, r.s, r.v) for r in out}
    assert got[199] == (D("0.00"), "Member", D("0.50"), "3 VND")          # 2.5 rounds half up
    assert got[200] == (D("5.00"), "Silver", D("0.70"), "1,234,568 VND")
    assert got[499] == (D("5.00"), "Silver", D("0.07"), "0 VND")
    assert got[500] == (D("7.00"), "Gold", D("8.00"), "1,000 VND")
    assert got[999] == (D("7.00"), "Gold", D("0.51"), "0 VND")            # NULL location -> 5 %
    assert got[1000] == (D("10.00"), "Platinum", D("0.01"), "1,000,000 VND")  # unknown location -> 5 %
    assert got[None] == (D("0.00"), "Member", D("0.17"), "12 VND")


def test_iso_week_53_label(spark):
    row = spark.createDataFrame([(dt.date(2027, 1, 1),)], "d date").select(
        F.concat(F.lit("Week "), F.weekofyear("d").cast("string"), F.lit(", "), F.year("d").cast("string")).alias("w")
    ).first()
    assert row.w == "Week 53, 2027"


# ------------------------------------------------------------------ B12
def test_menu_defaults(spark, menu, categories):
    from tavola.operators.views import menu_catalog

    d = make_domain(spark, menu_items=menu, categories=categories)
    got = {r.id: (r.category, r.description, r.prep_time) for r in menu_catalog(d).collect()}
    assert got[1] == ("Soup", "", 15)          # prep 0 -> 15
    assert got[2] == ("Soup", "", 15)          # prep NULL -> 15
    assert got[3] == ("Drink", "cold", 5)
    assert got[4] == ("Uncategorized", "", 7)


# -------------------------------------------------------- K3 / D10 / D21 / F7
def test_checkout_tolerance_ties_and_defaults(spark, floor):
    from tavola.operators.jobs import checkout_batch

    orders = spark.createDataFrame(
        [(k, t, 7, 0, ts("2024-01-01 12:00:00"), "served", ts("2024-01-01 00:00:00")) for k, t in ((1, 3), (2, 4), (3, 5))],
        "order_id long, table_id long, customer_id long, staff_id long, order_time timestamp_ntz, status string, order_day timestamp_ntz",
    )
    totals = spark.createDataFrame([(k, D("100.00"), 1) for k in (1, 2, 3)], "order_id long, sub_total decimal(18,2), line_count long")
    pay_t = "array<struct<method:string,amount:decimal(10,2)>>"
    req = spark.createDataFrame(
        [(1, 3, None, [("Cash", D("50.00")), ("CARD", D("50.00"))], D("0.00"), D("7.99")),   # total 115.99: paid 100 -> short
         (2, 3, None, [("card", D("60.00")), ("cash", D("60.00"))], D("0.00"), D("5.01")),   # total 113.01: paid 120 ok, tie -> card
         (3, 4, 9, [("ewallet", D("107.99"))], D("0.00"), D("0.00")),                        # 108.00 - 0.01 tolerance -> ok
         (4, 5, None, [("cash", D("107.98"))], D("0.00"), D("0.00")),                        # 0.02 short -> rejected
         (5, 1, None, [], D("0.00"), D("0.00"))],                                            # no active order
        f"request_id long, table_id long, customer_id long, payments {pay_t}, discount_amount decimal(18,2), service_charge decimal(18,2)",
    )
    d = make_domain(spark, dine_orders=orders, order_totals=totals, dining_tables=floor)
    got = {r.request_id: (r.outcome, r.primary_method, r.customer_id, r.points_earned) for r in checkout_batch(d, req).collect()}
    assert got[1][0] == "insufficient"
    assert got[2][:2] == ("paid", "card")
    assert got[3] == ("paid", "ewallet", 9, 0)   # 108 / 100000 * 50 -> 0 points
    assert got[4][0] == "insufficient"
    assert got[5][0] == "no_active_order"


def test_split_payment_fallback(spark):
    from tavola.operators.views import receipt_change, split_payments

    inv = spark.createDataFrame([(1, D("100.00")), (2, D("80.00"))], "invoice_id long, total_amount decimal(18,2)")
    pays = spark.createDataFrame(
        [(2, 1, D("100.00"), "ewallet"), (4, 2, D("30.00"), "cash"), (5, 2, D("30.00"), "bank_transfer"), (6, 2, D("30.00"), "card")],
        "payment_id long, invoice_id long, amount decimal(10,2), method string",
    )
    d = make_domain(spark, invoices=inv, payments=pays)
    got = rows(split_payments(d), "invoice_id", "payment_method", "amount")
    # e-wallet lands in no column -> one Cash row of the total
    assert got == [(1, "Cash", D("100.00")), (2, "Card", D("30.00")), (2, "Cash", D("30.00")), (2, "Transfer", D("30.00"))]
    change = {r.invoice_id: r.change for r in receipt_change(d).collect()}
    assert change == {1: D("0.00"), 2: D("10.00")}


# ------------------------------------------------------------------ empties
def test_reports_on_empty_input(spark, menu, categories):
    from tavola.operators.basket import basket_pairs
    from tavola.operators.reports import top_dishes

    empty = lines(spark, [])
    d = make_domain(spark, order_details=empty, menu_items=menu, categories=categories)
    assert top_dishes(d).count() == 0
    assert basket_pairs(d).count() == 0


def test_salted_pairs_equal_unsalted(spark, small_dir):
    """Hot-order salting changes the plan, never the pairs."""
    from tavola.operators.basket import basket_lines, order_pairs
    from tavola.sources.domain import Domain

    items = basket_lines(Domain(spark, small_dir)).groupBy("order_id", "dish_name").agg(F.count(F.lit(1)).alias("n"))

    def pairs(hot):
        return order_pairs(items, {"a": "dish_name", "na": "n"}, {"b": "dish_name", "nb": "n"},
                           lambda x, y: x["a"] <= y["b"], hot_items=hot, buckets=5)

    salted = rows(pairs(1))          # every order with 2+ dishes is "hot"
    plain = rows(pairs(10 ** 9))     # no order is hot
    assert salted == plain and len(plain) > 0


def _brute_force_signups(reqs, phones, emails):
    taken_p, taken_e, out = set(phones), set(emails), {}
    for r in sorted(reqs, key=lambda x: x["request_id"]):
        if r["phone"] in phones or (r["email"] is not None and r["email"] in emails):
            out[r["request_id"]] = "duplicate_existing"
        elif r["phone"] in taken_p or (r["email"] is not None and r["email"] in taken_e):
            out[r["request_id"]] = "duplicate_in_batch"
        else:
            out[r["request_id"]] = "accepted"
            taken_p.add(r["phone"])
            if r["email"] is not None:
                taken_e.add(r["email"])
    return out


def test_sequential_signups_match_one_at_a_time(spark, small_dir):
    from tavola.operators.jobs import duplicate_contacts_sequential
    from tavola.sources.domain import Domain

    d = Domain(spark, small_dir)
    reqs = [r.asDict() for r in d.customer_inserts.collect()]
    phones = {r.phone_number for r in d.customers.collect()}
    emails = {r.email for r in d.customers.collect() if r.email is not None}
    want = _brute_force_signups(reqs, phones, emails)
    got = {r.request_id: r.outcome for r in duplicate_contacts_sequential(d).collect()}
    assert got == want


def test_sequential_signups_chain(spark):
    """A accepted; B rejected (A's email); C takes B's phone: accepted, because B never got it."""
    from tavola.operators.jobs import duplicate_contacts_sequential

    cust = spark.createDataFrame([(1, "X", "0900", "x@x", None, None, 0, True)],
                                 "customer_id long, customer_name string, phone_number string, email string, "
                                 "address string, join_date date, loyalty_points int, is_active boolean")
    req = spark.createDataFrame([(1, "A", "p1", "e1"), (2, "B", "p2", "e1"), (3, "C", "p2", "e3"), (4, "D", "0900", None)],
                                "request_id long, name string, phone string, email string")
    d = make_domain(spark, customers=cust)
    got = {r.request_id: r.outcome for r in duplicate_contacts_sequential(d, req).collect()}
    assert got == {1: "accepted", 2: "duplicate_in_batch", 3: "accepted", 4: "duplicate_existing"}
