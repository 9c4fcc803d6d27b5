"""Invariants that hold whatever the data (SURVEY §5 (4))."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tavola.sources.domain import Domain


def test_revenue_rollups_agree(spark, small_dir):
    from tavola.operators.reports import revenue_latest_days, revenue_report

    d = Domain(spark, small_dir)
    days = revenue_latest_days(d, 30).agg(F.sum("daily_revenue"), F.sum("order_count")).first()
    week = revenue_report(d, "week").agg(F.sum("gross"), F.sum("orders")).first()
    month = revenue_report(d, "month").agg(F.sum("gross"), F.sum("orders")).first()
    assert days[0] == week[0] == month[0]
    assert days[1] == week[1] == month[1]


def test_pair_counts_sum_to_line_pairs(spark, small_dir):
    from tavola.operators.basket import basket_lines, pair_counts

    d = Domain(spark, small_dir)
    per_order = basket_lines(d).groupBy("order_id").count()
    want = per_order.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    got = pair_counts(d).agg(F.sum("times_ordered_together")).first()[0]
    assert int(want) == got


def test_accepted_batch_reservations_are_two_hours_apart(spark, small_dir):
    from tavola.operators.jobs import open_bookings, reservation_batch

    d = Domain(spark, small_dir)
    accepted = reservation_batch(d).where(F.col("outcome") == "confirmed").select("table_id", F.col("date_time").alias("t"))
    stored = open_bookings(d).select("table_id", F.col("reserved_at").alias("t"))
    by_table: dict[int, list[tuple[dt.datetime, bool]]] = {}
    for r in accepted.collect():
        by_table.setdefault(r.table_id, []).append((r.t, True))
    for r in stored.collect():
        by_table.setdefault(r.table_id, []).append((r.t, False))
    for items in by_table.values():
        items.sort()
        for (a, a_new), (b, b_new) in zip(items, items[1:]):
            if a_new or b_new:
                assert (b - a).total_seconds() >= 7200


def test_invoice_arithmetic_identities(spark, small_dir):
    d = Domain(spark, small_dir)
    bad = d.invoices.where(
        F.col("total_amount") != F.col("sub_total") - F.col("discount_amount") + F.col("service_charge") + F.col("tax_amount")
    ).count()
    assert bad == 0
    pays = d.payments.groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    mismatch = d.invoices.join(pays, "invoice_id").where(F.col("paid") != F.col("total_amount")).count()
    assert mismatch == 0


def test_status_log_chains(spark, small_dir):
    """Each log row's old status is the previous row's new status (per table)."""
    from tavola.operators.changes import status_log

    rows = sorted(status_log(Domain(spark, small_dir)).collect(), key=lambda r: (r.table_id, r.changed_at, r.seq))
    for a, b in zip(rows, rows[1:]):
        if a.table_id == b.table_id:
            assert b.old_status == a.new_status
        assert b.old_status != b.new_status


def test_results_do_not_depend_on_the_session_time_zone(spark, small_dir):
    """Zone-less data: windows and dates follow the data's wall clock in any session zone."""
    from tavola.operators.changes import daily_activity, hourly_activity
    from tavola.operators.views import daily_reservations

    d = Domain(spark, small_dir)
    before = spark.conf.get("spark.sql.session.timeZone")
    results = {}
    try:
        for tz in ("UTC", "Asia/Kolkata", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            results[tz] = [sorted(map(tuple, f(d).collect())) for f in (hourly_activity, daily_activity, daily_reservations)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert results["UTC"] == results["Asia/Kolkata"] == results["America/Los_Angeles"]
