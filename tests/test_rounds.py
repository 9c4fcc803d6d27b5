"""First-come decisions in rounds against one-at-a-time walks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tavola.operators.rounds import first_come_claims, first_come_contacts, first_come_slots
from tests.conftest import make_domain


def walk_slots(rows, width):
    taken, out = {}, {}
    for place, at, rid in sorted(rows, key=lambda r: r[2]):
        own = taken.setdefault(place, [])
        out[rid] = place is None or at is None or all(abs(at - x) >= width for x in own)
        if out[rid] and at is not None:
            own.append(at)
    return out


@pytest.mark.parametrize("order", ["mixed", "rising", "falling"])
def test_slots_without_a_gap(spark, order):
    """One busy table without a gap, a hot minute, negative times, rows without place or time."""
    rng = random.Random(order)
    rows = [(1, rng.randrange(-400, 900)) for _ in range(160)] + [(1, 77)] * 20 + [(2, 60 * k) for k in range(12)] + [(None, 5), (None, 5), (3, None)]
    if order == "mixed":
        rng.shuffle(rows)
    else:
        rows.sort(key=lambda r: (r[1] is None, r[1] or 0), reverse=order == "falling")
        rows = [r for k, r in enumerate(rows) if r[0] != 1 or k % 3 == 0]
    rows = [(place, at, k) for k, (place, at) in enumerate(rows)]
    got = {r.request_id: r.granted for r in first_come_slots(spark.createDataFrame(rows, "place long, at long, request_id long"), 120).collect()}
    assert got == walk_slots(rows, 120)


def test_slots_of_no_rows(spark):
    assert first_come_slots(spark.createDataFrame([], "place long, at long, request_id long"), 120).collect() == []


def test_a_busy_table_is_dealt_by_time(spark):
    """The round's joins are keyed by table and time slice, and nothing runs in Python."""
    from tavola.operators import rounds

    plans = []
    rows = spark.range(200).select((F.col("id") % 2).alias("place"), (F.col("id") * 50).alias("at"), F.col("id").alias("request_id"))
    settle, rounds.settle = rounds.settle, lambda df, decide, name: plans.append(decide(df)) or df.withColumn("granted", F.lit(True))
    try:
        first_come_slots(rows, 120)
    finally:
        rounds.settle = settle
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(place#\d+L, slice", text) and "Python" not in text and "Window" not in text


def test_claims_with_hot_contacts(spark):
    rng = random.Random(8)
    rows = [(k, [f"p{rng.randrange(40)}", None if k % 5 == 0 else f"e{rng.randrange(30)}"]) for k in range(150)]
    rows += [(200 + k, ["p-hot", f"x{k}"]) for k in range(60)] + [(300, []), (301, None), (302, [None])]
    held, want = set(), {}
    for rid, claims in sorted(rows, key=lambda r: r[0]):
        named = {c for c in claims or [] if c is not None}
        want[rid] = not named & held
        if want[rid]:
            held |= named
    got = {r.request_id: r.granted for r in first_come_claims(spark.createDataFrame(rows, "request_id long, claims array<string>")).collect()}
    assert got == want


def walk_contacts(changes, owners):
    """changes {id: (owner, {field: value})}, owners {(field, owner): value}."""
    now, out = dict(owners), {}
    for rid in sorted(changes):
        owner, named = changes[rid]
        held = {(f, v): o for (f, o), v in now.items()}
        out[rid] = all(held.get((f, v), owner) == owner for f, v in named.items())
        if out[rid]:
            now.update({(f, owner): v for f, v in named.items()})
    return out


@pytest.mark.parametrize("seed", range(4))
def test_contacts_change_hands(spark, seed):
    rng = random.Random(seed)
    people = 9
    owners = {("phone", o): f"p{o}" for o in range(people)} | {("email", o): f"e{o}" for o in range(0, people, 2)}
    changes = {}
    for rid in range(60):
        named = {}
        if rng.random() < 0.8:
            named["phone"] = f"p{rng.randrange(people + 4)}"
        if rng.random() < 0.5 or not named:
            named["email"] = f"e{rng.randrange(people + 2)}"
        changes[rid] = (rng.choice([0, rng.randrange(people)]), named)
    rows = [(rid, o, f, v) for rid, (o, named) in changes.items() for f, v in named.items()]
    got = first_come_contacts(
        spark.createDataFrame(rows, "request_id long, owner long, field string, value string"),
        spark.createDataFrame([(o, f, v) for (f, o), v in owners.items()], "owner long, field string, value string"),
    )
    assert {r.request_id: r.granted for r in got.collect()} == walk_contacts(changes, owners)


def test_updates_free_and_refused_ones_block_nobody(spark):
    from tavola.operators.jobs import customer_update

    people = "customer_id long, customer_name string, phone_number string, email string, address string, loyalty_points int, is_active boolean"
    customers = spark.createDataFrame([(k, f"C{k}", f"p{k}", None, None, 0, True) for k in (1, 2, 3)], people)
    asks = "request_id long, customer_id long, name string, phone string, email string, address string, points int, is_active boolean"
    req = spark.createDataFrame(
        [(1, 1, "n", "p2", None, None, None, None),   # taken by 2: refused whole
         (2, 2, None, "p9", None, None, None, None),  # frees p2
         (3, 3, None, "p2", "a@x", None, 5, None),    # takes it: the refused request blocks nobody
         (4, 1, None, None, "a@x", None, None, None),  # taken by 3
         (5, 3, None, None, "b@x", None, None, None),  # frees a@x
         (6, 1, None, None, "a@x", None, None, None),
         (7, 99, None, "p3", None, None, None, None)],  # no such customer
        asks,
    )
    got = {r.customer_id: tuple(r) for r in customer_update(make_domain(spark, customers=customers), req).collect()}
    assert got == {1: (1, "C1", "p1", "a@x", None, 0, True, 1), 2: (2, "C2", "p9", None, None, 0, True, 1), 3: (3, "C3", "p2", "b@x", None, 5, True, 2)}
