"""Full menu writes: a batch of dish creations and partial dish updates.

A request without ``dish_id`` creates a dish, one with it changes the fields that it names.  Both name
their category by its text; a category that does not exist is created by the first request that names
it, also when the dish of that request is unknown.  Ids go on from the stored ones in request order.
A created dish can be changed by later requests of the batch, and only by those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.operators.jobs import menu_upsert, merge_partial_updates
from tavola.operators.ranking import global_rank
from tavola.operators.staged import staged
from tavola.sources.domain import Domain

FIELDS = [("name", "dish_name"), ("category_id", "category_id"), ("price", "price"), ("description", "description"),
          ("is_available", "is_available"), ("prep_time", "preparation_time")]
STORED = ["dish_id", *(stored for _, stored in FIELDS)]


def resolved_writes(d: Domain, requests: DataFrame | None = None) -> DataFrame:
    """The requests with their ``category_id`` (existing or new), and ids for the dishes that they create; written once."""
    req = requests if requests is not None else d.menu_writes
    named = menu_upsert(d, req.where(F.col("category").isNotNull())).select("request_id", "category_id", "new_category")
    created = req.where(F.col("dish_id").isNull()).select("request_id")
    max_id = d.menu_items.select(F.max("dish_id")).scalar()
    new_ids = global_rank(created, [F.col("request_id")], "_n", method="row_number")
    new_ids = new_ids.select("request_id", (F.coalesce(max_id, F.lit(0)) + F.col("_n")).alias("new_dish"))
    return staged(req.join(named, "request_id", "left").join(new_ids, "request_id", "left"), "menu-writes")


def _created(writes: DataFrame) -> DataFrame:
    return writes.where(F.col("new_dish").isNotNull()).select("request_id", F.col("new_dish").alias("dish_id"), *[F.col(src).alias(stored) for src, stored in FIELDS])


def menu_created(d: Domain, writes: DataFrame | None = None) -> DataFrame:
    """The dish rows that the batch inserts, as they were at that moment."""
    return _created(resolved_writes(d) if writes is None else writes)


def menu_categories_created(d: Domain, writes: DataFrame | None = None) -> DataFrame:
    """The categories that the batch creates, under the name of the request that named them first."""
    rows = (resolved_writes(d) if writes is None else writes).where("new_category")
    return rows.groupBy("category_id").agg(F.min_by("category", "request_id").alias("category_name"), F.min("request_id").alias("request_id"))


def menu_update(d: Domain, writes: DataFrame | None = None) -> DataFrame:
    """The whole menu after the batch: stored and created dishes, with the number of updates of each."""
    writes = resolved_writes(d) if writes is None else writes
    created = _created(writes)
    current = d.menu_items.select(*STORED).unionByName(created.select(*STORED))
    updates = writes.where(F.col("dish_id").isNotNull()).select("request_id", "dish_id", *[src for src, _ in FIELDS])
    updates = updates.where(F.coalesce(*[F.col(src).cast("string") for src, _ in FIELDS]).isNotNull())  # no change requested
    born = created.select("dish_id", F.col("request_id").alias("_born"))
    updates = updates.join(born, "dish_id", "left").where(F.col("_born").isNull() | (F.col("_born") < F.col("request_id"))).drop("_born")
    return merge_partial_updates(current, updates, "dish_id", FIELDS)
