"""Mixing sources to target weights by hierarchical budgets; built-in functions only.

A corpus is a tree: domain, language, source.  The token budget goes down from the root: each node
shares its budget among its children by weight.  A child that can't use its share (its
tokens times ``max_epochs`` are fewer) leaves the shortage to its siblings; only when all
of them are full does it reach the siblings of an ancestor.  Both follow from filling the
children of one node at a time up to the capacities of their subtrees.  Shares are whole
tokens and add up exactly.

A leaf with budget b and t tokens takes ``b div t`` whole epochs and, of the next one, the shortest
prefix whose tokens reach the rest.  Each epoch has its own order, by MD5 of
(seed, epoch, id), then by the hash of the text; of rows that share both, as many as are needed are taken, which are alike.  The end of a prefix is found from sums over about sqrt(n) hash ranges
and then inside a single range, so no leaf is ever sorted as a whole; documents are then
picked by comparing their hash with the leaf's limit, without moving their text.

Defined cases: a null level is the node ''; a null text has no tokens and is taken when its
place in the order lies before the limit; a weight of 0 or null takes nothing; rows with one id, or without, follow each
other by the hashes of their texts, and only those that the budget needs are taken; a budget beyond all capacities takes everything ``max_epochs`` times; names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.staging import stage

_BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children: columns given (of the parent), weight, cap; adds ``budget``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_need = [F.when(F.col("weight") > 0, F.col("cap") / F.when(F.col("weight") > 0, F.col("weight"))), name]  # a child without weight has no capacity
    order = family.orderBy(*by_need).rowsBetween(Window.unboundedPreceding, 0)
    rest = family.orderBy(*by_need).rowsBetween(0, Window.unboundedFollowing)
    by_name = family.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: c.cast(_BIG)
    nodes = nodes.withColumn("before", big(F.sum("cap").over(order) - F.col("cap"))).withColumn("others", big(F.sum("weight").over(rest)))
    fits = big(F.col("cap")) * F.col("others") <= big(F.col("weight")) * (big(F.col("given")) - F.col("before"))
    nodes = nodes.withColumn("full", F.min(fits).over(order))
    nodes = nodes.withColumn("left", big(F.col("given")) - big(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family)))
    share = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    nodes = nodes.withColumn("upto", big(F.sum(share).over(by_name))).withColumn("share", big(share)).withColumn("all", big(F.sum(share).over(family)))
    part = F.expr("(upto * left) div all - ((upto - share) * left) div all")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("all") > 0, part).otherwise(0).cast("long")).drop("before", "others", "full", "left", "upto", "share", "all")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[Column], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens, docs) with their budgets in tokens."""
    weights = [F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)) for w in weights]
    usable = weights[0] > 0
    for w in weights[1:]:
        usable = usable & (w > 0)
    leaves = leaves.withColumn("cap", F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("long"))
    given = None
    for depth, (name, weight) in enumerate(zip(levels, weights, strict=True)):
        path = levels[: depth + 1]
        nodes = leaves.withColumn("weight", weight).groupBy(*path).agg(F.sum("cap").cast("long").alias("cap"), F.max("weight").alias("weight"))
        if given is None:
            total = leaves.agg(F.least(F.sum("cap"), budget.cast("long"))).scalar()
            nodes = nodes.withColumn("given", F.coalesce(total, F.lit(0)).cast("long"))
        else:
            nodes = nodes.join(given, levels[:depth])
        filled = _fill(nodes, levels[:depth], name)
        given = filled.select(*path, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), levels)


def selection(units: DataFrame, levels: list[str], weights: list[Column], budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: levels, tokens, budget, epochs (whole ones) and the end of the next epoch's prefix.

    The end is the place (``limit``, ``limit_mark``) of its last rows, ``taken`` of which, out of ``members``, belong to it; null
    for none.  ``units`` has doc_id, the levels, tokens and mark (hash of the text); the total budget is ``budget_share`` of all tokens.
    """
    leaves = stage(units.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(budget_share))).scalar()
    leaves = stage(leaf_budgets(leaves, levels, weights, total, max_epochs), "budgets")
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))

    part = leaves.where("rest > 0").withColumn("ranges", F.ceil(F.sqrt(F.col("docs").cast("double"))))
    alike = units.groupBy(*levels, "doc_id", "mark").agg(F.max("tokens").alias("each"), F.count("*").alias("members"))
    keyed = alike.join(part.select(*levels, "epochs", "rest", "ranges"), levels).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("range", F.expr("(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * ranges) div 4294967296")).withColumn("tokens", F.col("each") * F.col("members"))
    sums = keyed.groupBy(*levels, "rest", "range").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy(*levels).orderBy("range")))
    end = sums.where("upto >= rest and upto - sum < rest").select(*levels, "range", (F.col("upto") - F.col("sum")).alias("before"))
    inside = keyed.join(end, [*levels, "range"])
    inside = inside.withColumn("reached", F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("key", "mark")))
    last = inside.where("reached >= rest and reached - tokens < rest")
    due = F.ceil((F.col("rest") - F.col("reached") + F.col("tokens")) / F.col("each"))
    limit = last.select(*levels, F.col("key").alias("limit"), F.col("mark").alias("limit_mark"), due.alias("taken"), "members")
    return leaves.join(limit, levels, "left").select(*levels, F.col("tokens").alias("leaf_tokens"), "budget", "epochs", "limit", "limit_mark", "taken", "members")


def _first(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the first ``taken`` of each leaf marked by ``took``: numbered by parts of what was written, not by one task."""
    rows = stage(rows.withColumn("place", F.monotonically_increasing_id()), "alike").withColumn("chunk", F.shiftright("place", 33))
    counts = rows.groupBy(*names, "chunk").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy(*names).orderBy("chunk")) - F.col("n")
    numbered = rows.join(counts.withColumn("start", start).drop("n"), [*names, "chunk"])
    number = F.col("start") + F.row_number().over(Window.partitionBy(*names, "chunk").orderBy("place"))
    return numbered.withColumn("took", number <= F.col("taken")).drop("place", "chunk", "start")


def order_key(seed: int, epoch: Column, id: Column) -> Column:  # noqa: A002
    """Place of a document in an epoch: MD5 in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], budget_share: float, max_epochs: int = 1, seed: int = 0, text: str = "text", id: str = "doc_id", whole: bool = False) -> DataFrame:  # noqa: A002
    """The chosen documents, one row per epoch in which a document is taken.

    levels: name and expression over ``docs`` from the root's children down; weights: an expression over
    the level names for each level, relative among siblings, whole numbers.  Returns doc_id, the levels,
    tokens and epoch, or with ``whole`` the rows of ``docs`` as they are.
    """
    names = list(levels)
    fields = [F.coalesce(e.cast("string"), F.lit("")).alias(k) for k, e in levels.items()]
    mark = F.xxhash64(F.col(text).cast("string")).alias("mark")
    narrow = docs.select(F.col(id).alias("doc_id"), *fields, word_count(F.col(text)).alias("tokens"), mark)
    narrow = stage(narrow, "units")
    plan = stage(selection(narrow, names, weights, budget_share, max_epochs, seed), "selection")
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("doc_id"), *fields, mark) if whole else narrow
    rows = rows.join(plan, names).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    known = F.col("limit").isNotNull()
    at_end = F.coalesce(known & (F.col("key") == F.col("limit")) & (F.col("mark") == F.col("limit_mark")), F.lit(False))
    ahead = known & ((F.col("key") < F.col("limit")) | ((F.col("key") == F.col("limit")) & (F.col("mark") <= F.col("limit_mark"))))
    if plan.where("taken < members").isEmpty():
        rows = rows.withColumn("took", ahead)
    else:  # some of the rows at an end, which are alike, stay out
        cut = at_end & (F.col("taken") < F.col("members"))
        rows = rows.where(~cut).withColumn("took", ahead).unionByName(_first(rows.where(cut), names))
    rows = rows.withColumn("times", F.col("epochs") + F.col("took").cast("long")).where("times > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return rows.select("row.*") if whole else rows.select("doc_id", *names, "tokens", "epoch")
