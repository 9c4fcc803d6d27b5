"""Frequent sets without the sets of each order, large baskets, and FP-Growth mined once."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tavola.operators import basket as B


def item_rows(spark, baskets):
    return spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in sorted(b)], "order_id long, item string")


def test_no_sets_of_single_orders_are_written(spark, monkeypatch):
    written = []

    def counting(df, name, staged=B.staged):
        out = staged(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(B, "staged", counting)
    rng = random.Random(4)
    baskets = [set(rng.choices("abcdefghij", k=9)) for _ in range(300)]
    sets = {s: n for k in range(1, 5) for s, n in Counter(c for b in baskets for c in itertools.combinations(sorted(b), k)).items() if n >= 20}
    got = {tuple(r["items"]): r["orders"] for r in B.frequent_sets(item_rows(spark, baskets), 20, 4).collect()}
    assert got == sets
    assert max(n for _, n in written) <= 300  # the baskets, or counts of sets: 210 sets of four at most


def test_large_baskets_are_dealt_over_rows(spark):
    baskets = [set("abcdefg"), set("bcd"), set("a"), set("abcdefgh")]
    numbered = item_rows(spark, baskets).select("order_id", (F.ascii("item") - 96).alias("number"))
    rows = B._basket_rows(numbered, hot_items=5, buckets=3)
    assert rows.count() == 3 + 1 + 3
    got = Counter(tuple(r["items"]) for r in B._grown(rows, 2, [], None).collect())
    assert got == Counter(c for b in baskets for c in itertools.combinations([ord(x) - 96 for x in sorted(b)], 2))


@pytest.mark.parametrize("rows", [[(1, None), (2, None), (1, "a"), (2, "a")], [(None, "a"), (None, "b"), (1, "a"), (2, "a"), (1, "b"), (2, "b")]])
def test_null_items_and_orders_make_no_larger_sets(spark, rows):
    got = {tuple(r["items"]): r["orders"] for r in B.frequent_sets(spark.createDataFrame(rows, "order_id long, item string"), 2, 3).collect()}
    single = Counter((i,) for _, i in rows)
    assert got == dict(single) | ({("a", "b"): 2} if (1, "b") in rows else {})


def test_fp_growth_builds_its_trees_in_bounded_tasks_of_common_first_dishes(spark, monkeypatch):
    from pyspark.ml import fpm

    from tests.conftest import make_domain

    rng = random.Random(9)
    orders = [set(rng.choices(range(8), weights=range(1, 9), k=rng.choice([1, 3, 5]))) for _ in range(120)]
    d = make_domain(spark, menu_items=spark.createDataFrame([(k, 1, f"dish {k}" if k else None) for k in range(8)], "dish_id long, category_id long, dish_name string"),
                    order_details=spark.createDataFrame([(o, k) for o, ks in enumerate(orders) for k in ks], "order_id long, dish_id long"))
    seen = []

    def fit(self, df, plain=fpm.FPGrowth.fit):
        seen.append([p for p in df.rdd.map(lambda r: tuple(r["items"])).glom().collect() if p])
        return plain(self, df)

    monkeypatch.setattr(B, "TREE_BASKETS", 10)
    monkeypatch.setattr(fpm.FPGrowth, "fit", fit)
    got = {tuple(sorted(r["items"])): r["freq"] for r in B.fpgrowth_model(d, 0.05).freqItemsets.collect()}
    named = [tuple(sorted(f"dish {k}" for k in ks if k)) for ks in orders]
    assert got == {c: n for size in range(1, 6) for c, n in Counter(c for b in named for c in itertools.combinations(b, size)).items() if n >= 6}
    (parts,) = seen
    assert len(parts) > 8 and sum(map(len, parts)) == 120
    counts = Counter(x for b in named for x in b)
    assert all(list(b) == sorted(b, key=lambda x: (-counts[x], x)) for p in parts for b in p)
    assert max(len(ps) for ps in ({k for k, p in enumerate(parts) if b in p} for b in {b for p in parts for b in p})) == 1  # equal baskets meet
