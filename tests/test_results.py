"""Results of batch writes, the constraint report, itemsets, shared scans and bounded stream state on hand-written rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from decimal import Decimal as D

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tavola.sources.domain import Domain
from tests.conftest import make_domain, rows
from tests.test_edge_cases import ts
from tests.test_request_order import _orders

PAY = "array<struct<method:string,amount:decimal(10,2)>>"


# ------------------------------------------------------------------- K3
def test_checkout_results_agree(spark):
    from tavola.operators import settlement as S

    orders = _orders(spark, (1, 3, 7, "2024-01-01 11:00:00", "served"), (2, 3, 8, "2024-01-01 12:00:00", "open"), (3, 4, None, "2024-01-01 12:00:00", "open"),
                     (4, 4, 9, "2024-01-01 10:00:00", "open"))
    totals = spark.createDataFrame([(1, D("100000.00"), 1), (2, D("200000.00"), 1), (3, D("50.00"), 1), (4, D("10.00"), 1)], "order_id long, sub_total decimal(18,2), line_count long")
    zero = D("0.00")
    req = spark.createDataFrame(
        [(1, 3, None, [("cash", D("100000.00")), ("Card", D("116000.00"))], zero, zero),
         (2, 3, 5, [("transfer", D("60000.00")), ("bank_transfer", D("48000.00"))], zero, zero),  # the guest of the checkout wins
         (3, 4, None, [("ewallet", D("54.00"))], zero, zero),
         (4, 4, None, [("cash", D("1.00"))], zero, zero)],  # too little: nothing changes
        f"request_id long, table_id long, customer_id long, payments {PAY}, discount_amount decimal(18,2), service_charge decimal(18,2)",
    )
    d = make_domain(
        spark, dine_orders=orders, order_totals=totals, invoices=spark.createDataFrame([(40,)], "invoice_id long"),
        dining_tables=spark.createDataFrame([(3, "Occupied"), (4, "occupied"), (5, "occupied")], "table_id long, status string"),
        customers=spark.createDataFrame([(5, 10), (7, 1), (8, 0), (9, 2)], "customer_id long, loyalty_points int"),
    )
    settled = S.settle(d, req)
    inv = {r.order_id: r for r in S.checkout_invoices(d, settled).collect()}
    assert {k: (r.invoice_id, r.customer_id, r.payment_method, r.cash_amount, r.card_amount, r.transfer_amount) for k, r in inv.items()} == {
        2: (41, 8, "card", D("100000.00"), D("116000.00"), zero), 1: (42, 5, "transfer", zero, zero, D("108000.00")), 3: (43, None, "ewallet", zero, zero, zero)}
    assert inv[2].total_amount == D("216000.00") and inv[2].status == "paid"
    assert rows(S.checkout_orders(d, settled), "order_id", "old_customer", "customer_id", "old_status", "status") == [
        (1, 7, 5, "served", "closed"), (2, 8, 8, "open", "closed"), (3, None, None, "open", "closed")]
    assert rows(S.checkout_tables(d, settled)) == [(3, "occupied", "available", 2, 0), (4, "occupied", "available", 1, 1)]
    assert rows(S.checkout_points(d, settled)) == [(5, 1, 10, 54, 64), (8, 1, 0, 108, 108)]


# -------------------------------------------------------------- K6 / K7
def test_menu_writes_create_and_update(spark):
    from tavola.operators import menu_writes as M

    menu = "dish_id long, category_id long, dish_name string, category_name string, price decimal(10,2), description string, is_available boolean, preparation_time int"
    d = make_domain(
        spark, categories=spark.createDataFrame([(1, "Soup"), (2, "Tea")], "category_id long, category_name string"),
        menu_items=spark.createDataFrame([(10, 1, "Pho", "Soup", D("5.00"), "hot", True, 10), (11, 2, "Green", "Tea", D("2.00"), None, True, 3)], menu),
    )
    asks = "request_id long, dish_id long, name string, category string, price decimal(10,2), is_available boolean, description string, prep_time int"
    req = spark.createDataFrame(
        [(1, 12, "too early", None, None, None, None, None),       # dish 12 does not exist yet
         (2, None, "Cake", "sweets", D("4.00"), True, None, 20),   # creates dish 12 and a category
         (3, 12, None, None, D("4.50"), None, None, None),
         (4, 10, "Pho Bo", "Sweets ", None, False, None, None),    # the category of request 2, by its collation
         (5, 10, None, "SOUP", None, None, "mild", None),
         (6, None, "Chai", "tea", D("3.00"), True, "milk", 5),
         (7, 99, None, "Ghost", None, None, None, None),           # no such dish, yet its category is created
         (8, 11, None, None, None, None, None, None)],             # nothing to change
        asks,
    )
    writes = M.resolved_writes(d, req)
    assert rows(M.menu_created(d, writes), "request_id", "dish_id", "dish_name", "category_id", "price") == [
        (2, 12, "Cake", 3, D("4.00")), (6, 13, "Chai", 2, D("3.00"))]
    assert rows(M.menu_categories_created(d, writes)) == [(3, "sweets", 2), (4, "Ghost", 7)]
    got = {r.dish_id: tuple(r)[1:] for r in M.menu_update(d, writes).collect()}
    assert got == {
        10: ("Pho Bo", 1, D("5.00"), "mild", False, 10, 2), 11: ("Green", 2, D("2.00"), None, True, 3, 0),
        12: ("Cake", 3, D("4.50"), None, True, 20, 1), 13: ("Chai", 2, D("3.00"), "milk", True, 5, 0)}


# ------------------------------------------------------------------- A2
def test_constraint_facts_find_each_kind_of_violation(spark):
    from tavola.operators import quality as Q

    c = F.col
    rules = [
        Q.Rules("parent", [], "id"),
        Q.Rules("child", [Q._nn("name"), Q._ck("positive", c("n") > 0), Q._en("kind", ["a", "b"]), Q._len("name", 3)], "id", ["code"], [("of", "parent")]),
    ]
    tables = {
        "parent": spark.createDataFrame([(1,), (2,)], "id long"),
        "child": spark.createDataFrame(
            [(1, "x", 1, "A", "c1", 1), (2, None, 0, "z", "c1", 3), (3, "long", None, None, None, None), (4, "y", 5, "b", None, 3), (5, "y", 5, "b", "c1", 2)],
            "id long, name string, n int, kind string, code string, of long"),
    }
    got = {(r.table_name, r.check_name): r.violations for r in Q.violations(Q.fact_counts(tables, rules), rules).collect()}
    assert got == {("child", "not_null:name"): 1, ("child", "check:positive"): 1, ("child", "enum:kind"): 1, ("child", "length:name"): 1,
                   ("child", "unique:code"): 3, ("child", "fk:of->parent"): 2}


def test_each_table_is_scanned_once_for_all_rules(spark, small_dir, tmp_path):
    from tavola.operators import quality as Q
    from tavola.sources.layout import StoredDomain, write_domain
    from tests.test_plans import plan

    write_domain(Domain(spark, small_dir), str(tmp_path))
    tables = Q.schema_tables(StoredDomain(spark, str(tmp_path), small_dir))
    tables["table_status_log"] = spark.createDataFrame([], "table_id long, old_status string, new_status string, changed_by string")
    text = plan(Q.fact_counts(tables, Q.schema_rules())).split("\n\n")[0]
    assert text.count("Scan parquet") == 10


# ------------------------------------------------------------------ D12
def brute_sets(baskets, least, most):
    found = {}
    for size in range(1, most + 1):
        counts = Counter(s for items in baskets for s in itertools.combinations(sorted(items), size))
        found |= {s: n for s, n in counts.items() if n >= least}
    return found


@pytest.mark.parametrize("least", [2, 4, 9])
def test_frequent_sets_equal_brute_force(spark, least):
    from tavola.operators.basket import frequent_sets

    rng = random.Random(least)
    baskets = [set(rng.choices("abcdefgh", k=rng.choice([1, 2, 4, 7]))) for _ in range(60)] + [set("abcdefgh")] * 2 + [{"z"}]
    df = spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in b], "order_id long, item string")
    got = {tuple(r["items"]): r["orders"] for r in frequent_sets(df, least, 5).collect()}
    assert got == brute_sets(baskets, least, 5)


def test_frequent_sets_of_nothing(spark):
    from tavola.operators.basket import frequent_sets, min_orders

    assert frequent_sets(spark.createDataFrame([], "order_id long, item string"), 2).collect() == []
    assert (min_orders(0), min_orders(10_000), min_orders(20_001)) == (2, 2, 5)


def test_rules_below_a_threshold_are_left_out(spark, small_dir):
    from tavola.operators.basket import basket_rules

    d = Domain(spark, small_dir)
    every = basket_rules(d).collect()
    some = basket_rules(d, min_support=0.005, min_confidence=0.1).collect()
    assert 0 < len(some) < len(every)
    assert {(r.source, r.target) for r in some} == {(r.source, r.target) for r in every if r.support >= 0.005 and r.confidence >= 0.1}


# ------------------------------------------------- D14 / D15 / L3: one line scan
def line_scans(spark, build):
    """Jobs over the order lines while ``build`` runs and in its plan: file scans that read lineitem columns."""
    from tests.test_plans import plan

    return plan(build()).count("l_orderkey")


def test_insights_do_not_scan_the_lines_again(spark, small_dir):
    from tavola.operators import insights
    from tavola.plans.dashboard import sections

    d = Domain(spark, small_dir)
    assert line_scans(spark, lambda: insights.insights_rules(d)) == 0  # the one scan wrote the shared aggregate
    assert line_scans(spark, lambda: insights.insights_dashboard(d)) == 0
    for name in ("dishes", "top_dishes_table", "tables", "market_basket", "insights"):
        assert line_scans(spark, lambda n=name: sections(d)[n]) == 0


# --------------------------------------------------------- D6 / D7: newest months
def test_latest_days_read_the_newest_months_only(spark, small_dir, tmp_path):
    from tavola.operators.reports import latest_months, revenue_latest_days
    from tavola.sources.layout import StoredDomain, write_domain
    from tests.test_plans import plan

    write_domain(Domain(spark, small_dir), str(tmp_path))
    stored = StoredDomain(spark, str(tmp_path), small_dir)
    some = latest_months(stored.invoices, 7)
    files = len(stored.invoices.inputFiles())
    assert 0 < len(some.inputFiles()) and "PartitionFilters: [isnotnull(payment_month" in plan(some)
    assert some.select("payment_month").distinct().count() * 4 < stored.invoices.select("payment_month").distinct().count() <= files
    for n in (1, 7, 30, 100_000):
        assert revenue_latest_days(stored, n).collect() == revenue_latest_days(Domain(spark, small_dir), n).collect()


# -------------------------------------------------------------- J6 in SQL
def test_table_function_takes_any_month(spark, small_dir):
    from tavola.operators.lookups import register_table_functions
    from tavola.operators.reports import monthly_revenue

    d = Domain(spark, small_dir)
    register_table_functions(d)
    for month in (2, 12):
        found = spark.sql(f"SELECT f.day, f.revenue FROM monthly_revenue(1999, {month}) f WHERE f.bills > 0 ORDER BY day").collect()
        assert [tuple(r) for r in found] == [(r.day, r.revenue) for r in monthly_revenue(d, 1999, month).collect()]


# ----------------------------------------------------------- I1 / I2 / I3 streams
def event_files(folder, *parts):
    """events.parquet, events_1.parquet, ... and one table; each part is (event_id, user_id, type, day of January 2024)."""
    pq.write_table(pa.table({"s_suppkey": pa.array([0], pa.int64()), "s_nationkey": pa.array([0], pa.int64())}), f"{folder}/supplier.parquet")
    for k, part in enumerate(parts):
        pq.write_table(pa.table({
            "event_id": pa.array([e for e, _, _, _ in part], pa.int64()), "user_id": pa.array([u for _, u, _, _ in part], pa.int64()),
            "event_type": pa.array([t for _, _, t, _ in part]), "ts": pa.array([ts(f"2024-01-{day:02d} 10:00:00") for _, _, _, day in part], pa.timestamp("us")),
        }), f"{folder}/events{f'_{k}' if k else ''}.parquet")


def test_closed_orders_leave_the_state(spark, tmp_path):
    from tavola.streaming import feeds

    event_files(tmp_path, [(1, 1, "click", 1), (2, 2, "click", 1), (3, 1, "purchase", 2), (4, 3, "click", 2)], [(5, 2, "view", 9), (6, 4, "click", 9)], [(7, 4, "error", 10)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    base = f"{tmp_path}/run"
    with feeds.rocksdb_state(spark):
        events = feeds.stream_table(spark, str(tmp_path), "events", max_files=1)
        log = feeds.run_to_table(spark, feeds.status_log_stream(spark, str(tmp_path), events, keep_days=3), "log", base=base)
        state = spark.read.format("statestore").option("stateVarName", "orders").load(f"{base}/chk")
        held = {r["k"]: r["s"] for r in state.selectExpr("user_map_key.order_key AS k", "user_map_value.status AS s").collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert held == {2: "preparing", 3: "open", 4: "cancelled"}  # order 1 was closed a week before the watermark
    assert rows(log, "seq", "old_status", "new_status") == [(1, "available", "occupied"), (3, "occupied", "available"), (4, "available", "occupied"), (7, "occupied", "available")]


def test_completions_need_a_transition(spark):
    from tavola.operators import changes as C
    from tavola.streaming import feeds

    log = spark.createDataFrame(
        [(1, 10, "open", "closed", ts("2024-01-05 10:00:00"), 1),
         (2, 11, "closed", "closed", ts("2024-01-05 10:00:00"), 2),   # closed before the feed began
         (3, 12, None, "closed", ts("2024-01-05 10:00:00"), 3),       # came in as closed
         (4, 13, "open", "cancelled", ts("2024-01-05 10:00:00"), 4),
         (5, None, "open", "closed", ts("2024-01-05 10:00:00"), 5),   # without reservation
         (6, 14, "served", "closed", ts("2024-01-01 09:00:00"), 6),   # the reservation was made later
         (7, 10, "open", "closed", ts("2024-01-06 10:00:00"), 7),     # reopened and closed again
         (8, 15, "open", "closed", ts("2024-03-05 10:00:00"), 8)],    # long after
        "order_key long, reservation_id long, old_status string, new_status string, changed_at timestamp_ntz, seq long")
    made = spark.createDataFrame([(r, s, ts("2024-01-01 10:00:00")) for r, s in ((10, "cancelled"), (11, "pending"), (12, "pending"), (13, "pending"), (14, "pending"), (15, "pending"))],
                                 "reservation_id long, status string, created_at timestamp_ntz")
    want = [(10, "cancelled", "completed", 1, ts("2024-01-05 10:00:00")), (10, "cancelled", "completed", 7, ts("2024-01-06 10:00:00"))]
    batch = C.completions(log.withColumn("closed_at", C.instant_of(F.col("changed_at"))), made.withColumn("made_at", C.instant_of(F.col("created_at"))))
    assert rows(batch) == want
    stream = feeds.reservation_completions_stream(feeds.feed_folder(log.repartition(3), "log"), feeds.feed_folder(made, "made"))
    assert rows(feeds.run_to_table(spark, stream, "completions")) == want


# ------------------------------------------------------------------- I5
def test_audit_images_hold_nulls(spark):
    from tavola.operators.changes import audit_diff

    shape = "id long, name string, n int"
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], shape), spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, None, 1)], shape)
    assert rows(audit_diff(a, b, "id", "t"), "record_id", "action", "old_value", "new_value") == [
        (2, "UPDATE", '{"name":"y","n":1}', '{"name":"y","n":2}'), (3, "DELETE", '{"name":"z","n":1}', None), (4, "INSERT", None, '{"name":null,"n":1}')]


# ------------------------------------------------------------ broadcasts
def test_broadcasts_stop_at_rows_and_at_bytes(spark):
    from tavola.operators.joins import sized_broadcast

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("t"))
    assert hinted(sized_broadcast(df)) and not hinted(sized_broadcast(df, max_rows=99)) and not hinted(sized_broadcast(df, max_bytes=3000))
    assert hinted(sized_broadcast(df.limit(0)))


def test_references_meet_primary_keys_in_the_shuffle_that_counts_them(spark):
    from tavola.operators import quality as Q
    from tests.test_plans import plan

    rules = [Q.Rules("parent", [], "id"), Q.Rules("child", [Q._nn("x")], None, ["x"], [("a", "parent"), ("b", "parent"), ("c", "absent")])]
    tables = {"parent": spark.createDataFrame([(1,), (1,), (None,)], "id long"),
              "child": spark.createDataFrame([(1, 1, 1, "u"), (2, 1, None, None), (2, 3, 5, "u"), (None, 4, 5, None)], "a int, b long, c long, x string")}
    out = Q.violations(Q.fact_counts(tables, rules), rules)
    assert {(r.table_name, r.check_name): r.violations for r in out.collect()} == {
        ("child", "not_null:x"): 2, ("child", "unique:x"): 2, ("child", "fk:a->parent"): 2, ("child", "fk:b->parent"): 2, ("child", "fk:c->absent"): 3}
    text = plan(out)
    assert "LeftAnti" not in text and "lambda" not in text
