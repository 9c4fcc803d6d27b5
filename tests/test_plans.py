"""Plan properties that matter at scale: filters and projections reach the parquet scan."""

from __future__ import annotations

import contextlib
import io


from tavola.sources.domain import Domain


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_rolling_window_filter_reaches_orders_scan(spark, small_dir):
    d = Domain(spark, small_dir)
    p = plan(d.orders_since("2001-07-03 00:00:00").select("order_id"))
    assert "GreaterThan(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_month_filter_is_a_pushed_range(spark, small_dir):
    from tavola.operators.reports import monthly_revenue

    p = plan(monthly_revenue(Domain(spark, small_dir), 2001, 7))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p


def test_prefix_and_between_are_pushed(spark, small_dir):
    from tavola.operators.lookups import dish_prefix, reservations_between

    d = Domain(spark, small_dir)
    assert "StringStartsWith(p_name,red)" in plan(dish_prefix(d))
    p = plan(reservations_between(d))
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p


def test_projection_is_pruned_at_the_scan(spark, small_dir):
    from tavola.operators.reports import orders_by_hour

    p = plan(orders_by_hour(Domain(spark, small_dir)))
    # only the two columns the hour report needs are read from orders
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_lines_are_aggregated_before_the_dish_join(spark, small_dir):
    from tavola.operators.reports import dish_sales

    tree = plan(dish_sales(Domain(spark, small_dir))).split("\n\n")[0]
    # the tree prints the root first: the join sits above the (final) aggregate of the lines
    assert -1 < tree.find("Join") < tree.find("HashAggregate")


def test_no_broadcast_hint_on_growing_inputs(spark, small_dir):
    """Explicit broadcasts: the bounded per-partition offsets of global_rank, and the size-checked helper."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "tavola"
    hits = [str(p.relative_to(root)) for p in root.rglob("*.py") if "llm" not in p.parts and "F.broadcast(" in p.read_text()]
    assert sorted(hits) == ["operators/joins.py", "operators/ranking.py"], hits


def test_stored_lines_are_pruned_by_month_and_dealt_by_ranges(spark, small_dir, tmp_path):
    from tavola.operators.reports import top_selling_dishes
    from tavola.sources.layout import StoredDomain, write_domain

    write_domain(Domain(spark, small_dir), str(tmp_path))
    d = StoredDomain(spark, str(tmp_path), small_dir)
    p = plan(d.order_details.where("order_month >= date'2001-07-01'").select("order_id"))
    assert "PartitionFilters: [isnotnull(order_month" in p
    same = sorted(map(tuple, top_selling_dishes(d).collect()), key=str)
    assert same == sorted(map(tuple, top_selling_dishes(Domain(spark, small_dir)).collect()), key=str)


def test_mixed_case_statuses_are_normalised_on_load(spark, small_dir):
    from tavola.sources.domain import Domain, loaded

    class Mixed(Domain):
        @loaded
        def dining_tables(self):
            return spark.createDataFrame([(1, 4, "Occupied", None), (2, 2, None, "Terrace")], "table_id long, capacity int, status string, location string")

    got = [tuple(r) for r in Mixed(spark, small_dir).dining_tables.orderBy("table_id").collect()]
    assert got == [(1, 4, "occupied", "Main Hall"), (2, 2, "available", "Terrace")]
