"""First-come decisions in rounds: what one-at-a-time processing gives, without processing one at a time.

A batch of requests is decided as if each, in request order, were granted unless an earlier granted one
is in its way.  That is the lexicographically first maximal independent set of the conflicts,
and it is found in rounds of joins over all groups at once: an open request that no earlier
open request is in the way of is granted, the requests it is in the way of are refused, and so on until
none is open.  The first open request of every group is decided in each round, so the rounds end; there are about
as many as the longest chain of requests that wait for one another, which in batches of mixed
order grows with the logarithm of the batch.

Conflicts are never listed as pairs.  A round keeps one candidate for a time slice, or one claimer for a contact, so
a table or a telephone number with very many requests costs a grouped minimum and two
joins that adaptive execution can split.

Each round is written below the shared checkpoint folder: lost executors repeat a round, not
the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.operators.staged import new_folder, staged


def settle(rows: DataFrame, decide: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Every row with its ``granted`` (never null): ``decide`` gets the open rows and adds ``granted``, null for those that stay open."""
    spark = rows.sparkSession
    base, number = new_folder(spark, name), 0
    columns, left = rows.columns, rows
    while True:
        marked = decide(left)
        marked.write.parquet(f"{base}/round={number}")
        found = spark.read.schema(marked.schema).parquet(f"{base}/round={number}")
        left = found.where("granted is null").select(*columns)
        if left.isEmpty():
            break
        number += 1
    return spark.read.schema(marked.schema).parquet(base).where("granted is not null").drop("round")


def slice_of(at: Column, width: int) -> Column:
    """Number of the ``width``-wide slice that holds the integer ``at``, exact for negative values too."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def first_come_slots(requests: DataFrame, width: int) -> DataFrame:
    """(place, at, request_id) with ``granted``: whether no earlier granted request of the place is less than ``width`` away.

    Two requests of one slice of time are always in each other's way, so the earliest open one of each
    (place, slice) is the slice's only candidate; it is granted when no earlier open request of the
    slices beside it is in its way.  Rows without place or time are granted: nothing is in their way.
    """

    def beside(slots: DataFrame, steps: tuple[int, ...]) -> DataFrame:
        return slots.withColumn("step", F.explode(F.lit(list(steps)))).withColumn("slice", F.col("slice") + F.col("step"))

    def decide(rows: DataFrame) -> DataFrame:
        best = rows.where("slice is not null and place is not null").groupBy("place", "slice").agg(F.min(F.struct("request_id", "at")).alias("best"))
        rivals = beside(best, (-1, 1)).select("place", "slice", (F.col("slice") - F.col("step")).alias("of"), "best")
        earlier = (F.col("request_id") < F.col("best.request_id")) & (F.abs(F.col("at") - F.col("best.at")) < width)
        barred = rows.join(rivals, ["place", "slice"]).where(earlier).select("place", F.col("of").alias("slice")).distinct()
        won = best.join(barred, ["place", "slice"], "left_anti")
        near = beside(won, (-1, 0, 1)).groupBy("place", "slice").agg(F.collect_list("best").alias("near"))  # three at most
        met = rows.join(near, ["place", "slice"], "left")
        granted = F.exists("near", lambda w: w["request_id"] == F.col("request_id"))
        refused = F.exists("near", lambda w: F.abs(w["at"] - F.col("at")) < width)
        free = F.col("slice").isNull() | F.col("place").isNull()
        return met.select(*rows.columns, F.when(free | granted, True).when(refused, False).alias("granted"))

    rows = requests.select("place", F.col("at").cast("long").alias("at"), "request_id").withColumn("slice", slice_of(F.col("at"), width))
    return settle(rows, decide, "slots").drop("slice")


def first_come_claims(requests: DataFrame) -> DataFrame:
    """(request_id, claims) with ``granted``: whether none of its claims (an array) is held by an earlier granted request.

    Each open request claims all that it names; one that is the first open claimer of everything it names is
    granted, and whoever claims something of it is refused.  Null claims are none; a request without claims is granted.
    """

    def decide(rows: DataFrame) -> DataFrame:
        claims = rows.select("request_id", F.explode("claims").alias("claim"))
        first = claims.groupBy("claim").agg(F.min("request_id").alias("first"))
        met = claims.join(first, "claim")
        won = met.groupBy("request_id").agg(F.bool_and(F.col("request_id") == F.col("first")).alias("won")).where("won").select(F.col("request_id").alias("first"))
        taken = first.join(won, "first").select("claim", F.col("first").alias("holder"))
        said = claims.join(taken, "claim").groupBy("request_id").agg(F.bool_or(F.col("request_id") == F.col("holder")).alias("granted"))
        # a request with a claim that is taken is its holder, holding all it names, or refused
        out = rows.join(said, "request_id", "left")
        return out.select(*rows.columns, F.when(F.size("claims") == 0, True).otherwise(F.col("granted")).alias("granted"))

    named = F.array_compact(F.coalesce("claims", F.array().cast("array<string>")))
    return settle(requests.select("request_id", F.array_distinct(named).alias("claims")), decide, "claims")


def first_come_contacts(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """(request_id, granted) of requests to change contacts, as if made one by one.

    ``changes`` (request_id, owner, field, value): what a request of an owner sets; ``owners`` (owner, field,
    value): what they hold at first.  A request is refused whole when a value it names is held at
    that time by another owner.  A granted one takes its values and frees what its owner held in those fields.

    A value that only one owner ever names or holds can't be in the way; requests with such values only are
    granted at once.  The others are decided in rounds.  In a round the first open request for each contested value
    is looked at.  The value is held by its last granted taker (else its first owner), from then to that
    owner's next change of the field: is that before the request, the value is free (or, if that change is
    still open, the request waits); is it after, the request is refused.  A request is granted when it is first
    for all its contested values and none is held by another.  The first open request of all is decided in each
    round, so the rounds end.
    """
    spark = changes.sparkSession
    changes = staged(changes.where("value is not null").select("request_id", "owner", "field", "value"), "changes")
    held = owners.where("value is not null").select("owner", "field", "value")
    named = changes.select("field", "value").distinct()
    both = changes.select("owner", "field", "value").unionByName(held.join(named, ["field", "value"], "left_semi"))
    contested = both.groupBy("field", "value").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("field", "value")
    disputed = staged(changes.join(contested, ["field", "value"], "left_semi"), "disputed")
    first_owner = staged(held.join(contested, ["field", "value"], "left_semi").select("field", "value", F.col("owner").alias("first_owner")), "owners")

    base, number = new_folder(spark, "contacts"), 0
    kinds = "request_id long, granted boolean"
    waiting = disputed.select("request_id").distinct()
    free = changes.select("request_id").distinct().join(waiting, "request_id", "left_anti").select("request_id", F.lit(True).alias("granted"))
    free.write.parquet(f"{base}/round=0")
    while True:
        decided = spark.read.schema(kinds).parquet(base).drop("round")
        left = disputed.join(decided, "request_id", "left_anti")
        if left.isEmpty():
            return decided
        number += 1
        _contact_round(changes, disputed, first_owner, decided, left).write.parquet(f"{base}/round={number}")


def _contact_round(changes: DataFrame, disputed: DataFrame, first_owner: DataFrame, decided: DataFrame, left: DataFrame) -> DataFrame:
    """The requests that the state after the rounds so far decides: (request_id, granted)."""
    key = ["field", "value"]
    look = left.groupBy(*key).agg(F.min(F.struct("request_id", "owner")).alias("r")).select(*key, "r.*")
    granted = decided.where("granted").select("request_id")
    taken = disputed.join(granted, "request_id", "left_semi").groupBy(*key).agg(F.max(F.struct(F.col("request_id").alias("since"), F.col("owner").alias("holder"))).alias("t"))
    look = look.join(first_owner, key, "left").join(taken, key, "left")
    look = look.select("request_id", "owner", *key, F.coalesce("t.since", F.lit(-1).cast("long")).alias("since"), F.coalesce("t.holder", "first_owner").alias("holder"))

    # what the holders change in that field after they took the value: granted or still open
    refused = decided.where("not granted").select("request_id")
    moves = changes.join(refused, "request_id", "left_anti").join(granted.withColumn("sure", F.lit(True)), "request_id", "left")
    moves = moves.select(F.col("owner").alias("holder"), "field", F.col("request_id").alias("moved"), F.coalesce("sure", F.lit(False)).alias("sure"))
    rivals = look.where("holder <> owner")
    met = rivals.join(moves, ["holder", "field"], "left").where("moved is null or (moved > since and moved < request_id)")
    until = met.groupBy("request_id", *key).agg(F.min(F.struct("moved", "sure")).alias("m"))
    state = look.join(until, ["request_id", *key], "left").withColumn("rival", F.coalesce(F.col("holder") != F.col("owner"), F.lit(False)))
    freed, stuck = F.coalesce(F.col("m.sure"), F.lit(False)), F.col("m.moved").isNull()
    state = state.select("request_id", (F.col("rival") & stuck).alias("barred"), (~F.col("rival") | freed).alias("clear"))
    looked = state.groupBy("request_id").agg(F.bool_or("barred").alias("barred"), F.count(F.when(F.col("clear"), 1)).alias("clear"))
    due = left.groupBy("request_id").agg(F.count("*").alias("due")).join(looked, "request_id")
    return due.where(F.col("barred") | (F.col("clear") == F.col("due"))).select("request_id", (~F.col("barred")).alias("granted"))
