"""Market-basket mining over order lines.

Plan shape, chosen for very large line tables:

1. lines -> (order_id, dish_name, n): a partial+final aggregate collapses repeated
   dishes of an order before anything is paired;
2. a self-join on order_id pairs *distinct* names of an order (name_a <= name_b);
   the pair weight is n_a * n_b (or n(n-1)/2 for a dish with itself), which is
   exactly the number of line pairs the reference's ``combinations`` would emit,
   without emitting them one by one;
3. pair weights are summed per (item_1, item_2) with a partial aggregate.

A very large order is a skewed join key.  ``order_pairs`` salts such hot
orders explicitly: orders with more than ``HOT_ITEMS`` distinct dishes are found
with a (partially aggregated) count, their left side is spread over
``SALT_BUCKETS`` salts by dish hash and their right side is replicated to every
salt, so the pairs of one order are produced by many tasks.  Ordinary orders keep
salt 0 and are not replicated.  The hot-order list is joined without a broadcast
hint (adaptive execution broadcasts it only when it is actually small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.scalar import MONEY_SUM
from tavola.operators.staged import staged
from tavola.sources.domain import Domain

# Orders with more distinct dishes than this are split across SALT_BUCKETS tasks.
HOT_ITEMS = 1000
SALT_BUCKETS = 16


def order_sizes(items: DataFrame) -> DataFrame:
    """Distinct items per order (partial+final aggregate, one row per order)."""
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_k"))


def order_pairs(items: DataFrame, left: dict[str, str], right: dict[str, str], cond, hot_items: int = HOT_ITEMS,
                buckets: int = SALT_BUCKETS, sizes: DataFrame | None = None) -> DataFrame:
    """Self-join of per-order item rows on order_id, salted for orders with many distinct items.

    ``items`` has one row per (order_id, item); ``left`` / ``right`` map output
    names to ``items`` columns for the two sides; ``cond(a, b)`` is the residual
    pair condition on the two sides' columns.  ``sizes`` (from ``order_sizes``)
    may be passed when the caller needs it too.
    """
    sizes = sizes if sizes is not None else order_sizes(items)
    hot = sizes.where(F.col("_k") > hot_items).select("order_id", F.lit(True).alias("_hot"))
    tagged = items.join(hot, "order_id", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    first_col = next(iter(left.values()))
    a = tagged.select(
        "order_id",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(first_col)), F.lit(buckets))).otherwise(F.lit(0)).alias("_salt"),
        *[F.col(src).alias(dst) for dst, src in left.items()],
    )
    b = tagged.select(
        "order_id",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
                  .otherwise(F.array(F.lit(0).cast("long")))).alias("_salt"),
        *[F.col(src).alias(dst) for dst, src in right.items()],
    )
    joined = a.join(b, (a["order_id"] == b["order_id"]) & (a["_salt"] == b["_salt"]) & cond(a, b))
    return joined.select(a["order_id"], *[a[k] for k in left], *[b[k] for k in right])


def order_dishes(d: Domain) -> DataFrame:
    """(order_id, dish_id, n, quantity, line_total): the lines of an order by dish; one scan of the order lines."""
    return d.order_details.groupBy("order_id", "dish_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("long").alias("quantity"), F.sum("line_total").cast(MONEY_SUM).alias("line_total")
    )


def shared_order_dishes(d: Domain) -> DataFrame:
    """``order_dishes`` written once, for several reports to read: pass it to them as ``facts``."""
    return staged(order_dishes(d), "order-dishes")


def basket_lines(d: Domain, facts: DataFrame | None = None) -> DataFrame:
    """(order_id, dish_name) per order line (with ``facts``: per order and dish): lines joined to dishes that have a category."""
    dishes = d.menu_items.where(F.col("category_id").isNotNull()).select("dish_id", "dish_name")
    lines = d.order_details if facts is None else facts
    return lines.select("order_id", "dish_id").join(dishes, "dish_id").select("order_id", "dish_name")


def pair_counts(d: Domain) -> DataFrame:
    """All unordered dish-name pairs with the number of line pairs and the first order they appear in."""
    per_order = basket_lines(d).groupBy("order_id", "dish_name").agg(F.count(F.lit(1)).alias("n"))
    pairs = order_pairs(
        per_order, {"item_1": "dish_name", "n1": "n"}, {"item_2": "dish_name", "n2": "n"},
        lambda a, b: a["item_1"] <= b["item_2"],
    ).select(
        "order_id", "item_1", "item_2",
        F.when(F.col("item_1") == F.col("item_2"), (F.col("n1") * (F.col("n1") - 1) / 2).cast("long"))
        .otherwise(F.col("n1") * F.col("n2")).alias("w"),
    ).where(F.col("w") > 0)
    return pairs.groupBy("item_1", "item_2").agg(
        F.sum("w").cast("long").alias("times_ordered_together"),
        F.min("order_id").alias("first_order_id"),
    )


def basket_pairs(d: Domain, k: int = 5) -> DataFrame:
    """Top-k pairs; ties keep first-seen order (smallest order id, then item_1, item_2)."""
    return pair_counts(d).orderBy(
        F.col("times_ordered_together").desc(), "first_order_id", "item_1", "item_2"
    ).limit(k).select("item_1", "item_2", "times_ordered_together")


def item_baskets(d: Domain, facts: DataFrame | None = None) -> DataFrame:
    """Distinct dish names per order."""
    return basket_lines(d, facts).distinct()


def basket_rules(d: Domain, facts: DataFrame | None = None, min_support: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Directed rules source -> target on distinct items per order: support, confidence, lift.

    confidence_pct = int(confidence * 100), as the dashboard computes it.  Rules below ``min_support`` (share of
    the orders) or ``min_confidence`` are left out; both are 0 in the dashboard, which is every pair that occurs.
    """
    items = item_baskets(d, facts)
    sizes = order_sizes(items)
    n_orders = sizes.select(F.count(F.lit(1))).scalar()  # baskets = orders with at least one item
    item_count = items.groupBy("dish_name").agg(F.count(F.lit(1)).alias("cnt"))
    pair = (
        order_pairs(items, {"source": "dish_name"}, {"target": "dish_name"}, lambda a, b: a["source"] != b["target"],
                    sizes=sizes)
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("pair_count"))
    )
    sa = item_count.select(F.col("dish_name").alias("source"), F.col("cnt").alias("source_count"))
    tb = item_count.select(F.col("dish_name").alias("target"), F.col("cnt").alias("target_count"))
    if min_support > 0:
        pair = pair.where(F.col("pair_count") / n_orders >= min_support)  # before the joins: the table of pairs is the large one
    r = pair.join(sa, "source").join(tb, "target")
    conf = F.col("pair_count") / F.col("source_count")
    if min_confidence > 0:
        r = r.where(conf >= min_confidence)
    return r.select(
        "source", "target", "pair_count", "source_count", "target_count",
        (F.col("pair_count") / n_orders).alias("support"),
        conf.alias("confidence"),
        (conf / (F.col("target_count") / n_orders)).alias("lift"),
        F.floor(conf * 100).cast("int").alias("confidence_pct"),
    )


def top_rules(d: Domain, k: int = 2, facts: DataFrame | None = None) -> DataFrame:
    """Best rules by pair count (then confidence, names): the dashboard's pair cards."""
    return basket_rules(d, facts).orderBy(
        F.col("pair_count").desc(), F.col("confidence").desc(), "source", "target"
    ).limit(k)


# ------------------------------------------------- D12: sets of three and more dishes
#: Orders in ten thousand that must hold a set, and the most dishes of a set.
PER_10K, MAX_ITEMS = 2, 4
#: Baskets of a task that builds FP-trees; its trees are walked again and again to estimate their size, so they stay small.
TREE_BASKETS = 20_000


def min_orders(orders: int, per_10k: int = PER_10K) -> int:
    """Least number of orders of a frequent set: ``per_10k`` in ten thousand, rounded up, two at least."""
    return max(2, -(-orders * per_10k // 10_000))


def frequent_sets(baskets: DataFrame, least: int, max_items: int = MAX_ITEMS) -> DataFrame:
    """(items, orders): the sets of up to ``max_items`` items that ``least`` baskets or more hold.

    ``baskets`` has distinct rows (order_id, item).  A basket becomes one row, the sorted array of the numbers of its
    frequent items.  Level by level: a candidate of k + 1 items joins two frequent sets of k items that differ in the last
    one, and stays when all its subsets of k items are frequent.  Each level grows the sets of a basket again from the
    basket, through the frequent sets of the levels before, and counts them in the tasks that grow them: what is written
    is the baskets, once, and counts of sets, never the sets of each order.  ``items`` is a sorted array.
    """
    counts = staged(baskets.groupBy("item").agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") >= least), "counts")
    out = counts.select(F.array("item").alias("items"), "orders")
    # at most (items of a basket) / (least share of the baskets) items are frequent, so one window numbers them
    numbers = staged(counts.select("item", F.row_number().over(Window.orderBy("item")).alias("number")), "numbers")
    numbered = baskets.where(F.col("order_id").isNotNull()).join(numbers, "item").select("order_id", "number")
    rows = staged(_basket_rows(numbered), "rows")
    level, levels = None, []
    for size in range(2, max_items + 1):
        wanted = None if level is None else staged(_candidates(level, size - 1).select(F.concat("items", F.array("last")).alias("items")), "wanted")
        found = _grown(rows, size, levels, wanted).groupBy("items").agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") >= least)
        level = staged(found, "sets")
        if level.isEmpty():
            break
        levels.append(level)
    for level in levels:
        out = out.unionByName(_with_names(level, numbers))
    return out


def _basket_rows(numbered: DataFrame, hot_items: int = HOT_ITEMS, buckets: int = SALT_BUCKETS) -> DataFrame:
    """(numbers, first): the sorted item numbers of a basket and the places its sets may start at.

    A basket of more than ``hot_items`` items is dealt over ``buckets`` rows, each with its share of the places.
    """
    rows = numbered.groupBy("order_id").agg(F.array_sort(F.collect_list("number")).alias("numbers")).where(F.size("numbers") > 1)
    rows = rows.select("numbers", F.size("numbers").alias("n"))
    cold = rows.where(F.col("n") <= hot_items).select("numbers", F.sequence(F.lit(1), F.col("n")).alias("first"))
    shares = F.sequence(F.lit(1), F.lit(buckets))
    hot = rows.where(F.col("n") > hot_items).select("numbers", "n", F.explode(shares).alias("share")).repartition(buckets, "share")
    return cold.unionByName(hot.select("numbers", F.sequence(F.col("share"), F.col("n"), F.lit(buckets)).alias("first")))


def _grown(rows: DataFrame, size: int, levels: list[DataFrame], wanted: DataFrame | None) -> DataFrame:
    """(items): the sets of ``size`` items of each basket, a row each; those of ``wanted`` alone, where it is given."""

    def rest(place: str) -> Column:  # the places after this one; none after the last
        return F.when(F.col(place) < F.size("numbers"), F.sequence(F.col(place) + 1, F.size("numbers")))

    sets = rows.select("numbers", F.explode("first").alias("place"))
    sets = sets.select("numbers", "place", F.array(F.element_at("numbers", F.col("place"))).alias("items"))
    for k in range(2, size + 1):
        sets = sets.select("numbers", "items", F.explode(rest("place")).alias("place"))
        sets = sets.select("numbers", "place", F.concat("items", F.array(F.element_at("numbers", F.col("place")))).alias("items"))
        known = wanted if k == size else levels[k - 2]
        if known is not None:
            sets = sets.join(known.select("items"), "items", "left_semi")
    return sets.select("items")


def _with_names(level: DataFrame, numbers: DataFrame) -> DataFrame:
    """The sets with the items' own values for their numbers."""
    single = level.select("items", "orders", F.explode("items").alias("number")).join(numbers, "number")
    named = single.groupBy("items", "orders").agg(F.array_sort(F.collect_list("item")).alias("named"))
    return named.select(F.col("named").alias("items"), "orders")


def _candidates(level: DataFrame, size: int) -> DataFrame:
    """(items, last): sets of ``size`` items and a larger item, all of whose subsets of ``size`` items are in ``level``."""
    parts = level.select("items", F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"))
    more = parts.select("head", F.col("last").alias("more"))
    pairs = parts.join(more, "head").where("last < more").select("items", F.col("more").alias("last"))
    # the two joined sets are frequent; the others leave out one of the first size - 1 items
    drops = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda k: F.concat(F.filter("items", lambda x, i: i != k), F.array("last")))
    subsets = pairs.select("items", "last", F.explode(drops).alias("subset"))
    known = subsets.join(level.select(F.col("items").alias("subset")), "subset", "left_semi")
    return known.groupBy("items", "last").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 1).select("items", "last")


def _named_baskets(d: Domain) -> tuple[DataFrame, int]:
    baskets = staged(item_baskets(d).select("order_id", F.col("dish_name").alias("item")), "baskets")
    return baskets, baskets.select(F.countDistinct("order_id")).first()[0]


def _said(items) -> Column:
    return F.array_join(items, " + ")


def basket_itemsets(d: Domain, per_10k: int = PER_10K, max_items: int = MAX_ITEMS) -> DataFrame:
    """Sets of two and more dishes that at least ``per_10k`` in ten thousand orders hold: items, size, orders, support."""
    baskets, n = _named_baskets(d)
    found = frequent_sets(baskets, min_orders(n, per_10k), max_items).where(F.size("items") > 1)
    return found.select(_said("items").alias("items"), F.size("items").alias("size"), "orders", (F.col("orders") / F.lit(n)).alias("support"))


def basket_set_rules(d: Domain, per_10k: int = PER_10K, max_items: int = MAX_ITEMS, min_confidence: float = 0.0) -> DataFrame:
    """Rules from two or more dishes to one more: antecedent, consequent, orders, support, confidence, lift.

    Rules between single dishes are those of ``basket_rules``.
    """
    baskets, n = _named_baskets(d)
    sets = staged(frequent_sets(baskets, min_orders(n, per_10k), max_items), "sets")
    large = sets.where(F.size("items") > 2).select("items", "orders", F.explode("items").alias("consequent"))
    large = large.withColumn("antecedent", F.filter("items", lambda x: x != F.col("consequent")))
    one = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("orders").alias("of_consequent"))
    some = sets.select(F.col("items").alias("antecedent"), F.col("orders").alias("of_antecedent"))
    rules = large.join(some, "antecedent").join(one, "consequent")
    confidence = F.col("orders") / F.col("of_antecedent")
    rules = rules.select(
        _said("antecedent").alias("antecedent"), "consequent", "orders", (F.col("orders") / F.lit(n)).alias("support"),
        confidence.alias("confidence"), (confidence / (F.col("of_consequent") / F.lit(n))).alias("lift"),
    )
    return rules.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else rules


def basket_fpgrowth(d: Domain, min_support: float = 0.001, min_confidence: float = 0.0) -> DataFrame:
    """Association rules from Spark ML's distributed FP-Growth over the distinct-item baskets.

    Returned: the single-item rules (antecedent and consequent of one dish), so
    they can be compared with ``basket_rules`` restricted to the same support.
    Longer itemsets are available from ``fpgrowth_model``.
    """
    model = fpgrowth_model(d, min_support, min_confidence)
    rules = model.associationRules
    one = rules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1))
    return one.select(
        F.col("antecedent")[0].alias("source"),
        F.col("consequent")[0].alias("target"),
        F.col("confidence"),
        F.col("lift"),
        F.col("support"),
    )


def fpgrowth_baskets(d: Domain) -> DataFrame:
    """(items, ranks): the distinct dishes of each order and their ranks, the most frequent dish first; written once."""
    items = staged(item_baskets(d), "items")
    counts = items.groupBy("dish_name").agg(F.count(F.lit(1)).alias("orders"))
    ranks = staged(counts.select("dish_name", F.row_number().over(Window.orderBy(F.col("orders").desc(), "dish_name")).alias("rank")), "ranks")
    ranked = items.join(ranks, items["dish_name"].eqNullSafe(ranks["dish_name"])).select("order_id", "rank", items["dish_name"])
    baskets = ranked.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("rank", "dish_name"))).alias("b"))
    named = F.filter("b", lambda x: x["dish_name"].isNotNull())
    return staged(baskets.select(named["dish_name"].alias("items"), named["rank"].alias("ranks")), "fpgrowth-baskets")


def fpgrowth_model(d: Domain, min_support: float = 0.001, min_confidence: float = 0.0):
    return _fitted(fpgrowth_baskets(d), min_support, min_confidence)


def _fitted(baskets: DataFrame, min_support: float, min_confidence: float):
    """FP-Growth in tasks of ``TREE_BASKETS`` baskets with common first dishes, so that they share the branches of their trees."""
    from pyspark.ml.fpm import FPGrowth

    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(parts, -(-baskets.count() // TREE_BASKETS))
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=parts)
    return growth.fit(baskets.repartitionByRange(tasks, "ranks").select("items"))
