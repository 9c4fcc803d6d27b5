"""Library entry points that are not catalogued queries: dashboard, lookups, sinks, stream modes."""

from __future__ import annotations

import os

import pytest
import tempfile

from pyspark.sql import functions as F

from tests.conftest import rows


def test_dashboard_sections(spark, small_dir):
    from tavola.plans.dashboard import dashboard

    dash = dashboard(spark, small_dir)
    assert set(dash) >= {"kpi", "revenue_week", "tables", "customers", "insights", "market_basket"}
    assert dash["kpi"].count() == 1
    assert dash["customers"].count() == 5
    assert dash["insights"].count() == 3


def test_invoice_point_lookup(spark, small_dir):
    from tavola.operators.lookups import invoice_detail
    from tavola.sources.domain import Domain

    d = Domain(spark, small_dir)
    some = d.invoices.orderBy("invoice_id").first().invoice_id
    detail = invoice_detail(d, some)
    assert detail["info"].count() == 1
    lines = d.order_details.where(F.col("order_id") == some).count()
    assert detail["items"].count() == lines
    total = detail["info"].first().total
    paid = sum(r.amount for r in detail["payments"].collect())
    assert paid == total


def test_sink_round_trip(spark, small_dir):
    from tavola.sources.connectors import export_reports, read_table

    out = tempfile.mkdtemp(prefix="tavola-sink-", dir="/tmp")
    written = export_reports(spark, small_dir, out, ["daily_revenue", "top_dishes"], fmt="parquet")
    assert set(written) == {"daily_revenue", "top_dishes"}
    back = read_table(spark, written["top_dishes"])
    assert back.count() == 5
    assert os.path.isdir(written["daily_revenue"])


def test_hourly_stream_append_mode_emits_closed_windows(spark, small_dir):
    """Append mode with a watermark emits only closed windows, each equal to its batch value."""
    from tavola.operators.changes import hourly_activity
    from tavola.sources.domain import Domain
    from tavola.streaming.feeds import hourly_activity_stream, run_to_table

    out = run_to_table(spark, hourly_activity_stream(spark, small_dir, delay="1 hour"), "hourly_append")
    batch = hourly_activity(Domain(spark, small_dir))
    got = rows(out)
    assert 0 < len(got) <= batch.count()
    assert set(got) <= set(rows(batch.select(*out.columns)))


def test_table_state_from_stream_log_matches_batch(spark, small_dir):
    from tavola.operators.changes import table_state
    from tavola.sources.domain import Domain
    from tavola.streaming.feeds import run_to_table, status_log_stream, table_state_from_log

    d = Domain(spark, small_dir)
    log = run_to_table(spark, status_log_stream(spark, small_dir), "state")
    got = rows(table_state_from_log(d, log), "table_id", "status")
    want = rows(table_state(d), "table_id", "status")
    assert got == want


def test_status_stream_drops_late_events_across_batches(spark, small_dir, tmp_path):
    """Two micro-batches: an event older than the table's last applied one is late and not applied;
    closing an already closed order does not free the table again."""
    import datetime as dt

    from tavola.streaming import feeds

    src = tmp_path / "events"
    src.mkdir()
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t = dt.datetime(2024, 1, 1, 12, 0)
    first = [(1, t, 3, "click", 1.0, None), (2, t + dt.timedelta(minutes=30), 3, "purchase", 1.0, None)]
    later = [(3, t + dt.timedelta(minutes=10), 3, "signup", 1.0, None),   # older than event 2: late
             (4, t + dt.timedelta(hours=2), 3, "signup", 1.0, None),      # reserved
             (5, t + dt.timedelta(hours=3), 3, "purchase", 1.0, None)]    # order already closed: no change
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(src / "a"))
    spark.createDataFrame(later, schema).coalesce(1).write.parquet(str(src / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    log = feeds.run_to_table(spark, feeds.status_log_stream(spark, small_dir, events=stream), "late_test")
    got = sorted((r.seq, r.old_status, r.new_status) for r in log.collect())
    # table 3 (user 3 % 10 tables) starts in maintenance in the sf0.001 mapping
    assert got == [(1, "maintenance", "occupied"), (2, "occupied", "available"), (4, "available", "reserved")]


@pytest.fixture(scope="module")
def stored(spark, small_dir, tmp_path_factory):
    from tavola.sources.domain import Domain
    from tavola.sources.layout import StoredDomain, write_domain

    out = str(tmp_path_factory.mktemp("domain"))
    write_domain(Domain(spark, small_dir), out)
    return StoredDomain(spark, out, small_dir)


def test_stored_layout_gives_the_same_answers(spark, small_dir, stored):
    """Materialised domain (date-partitioned facts): the catalogue gives the same answers."""
    from tavola.plans.catalog import CATALOG
    from tavola.sources.domain import Domain

    for name in ["top_selling_dishes", "daily_revenue", "monthly_revenue", "floor_view", "status_log"]:
        fn = CATALOG[name]
        want = fn(Domain(spark, small_dir))
        got = fn(stored).select(*want.columns)
        assert rows(got) == rows(want), name


def test_stored_layout_prunes_month_partitions(stored):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        stored.orders_since("2001-07-03 00:00:00").explain("formatted")
    assert "PartitionFilters: [isnotnull(order_month" in buf.getvalue()
