"""Exact dedup with two passes over a Bloom filter of repeated hashes; built-in functions only.

Pass 1 hashes every text to ``PROBES`` positions and counts the rows of each position;
the positions of two rows or more are the filter.  Pass 2 looks every row up: a row with
a position of its own is surely unique and passes straight through, without a shuffle.
Only the others are grouped by the SHA-256 of their whole text, which decides.

The filter has a fixed size bound: ``BITS_PER_ROW`` bits a row and ``2 ** MAX_LOG_BITS``
bits (128 MB) at most, in 4 KB segments; that is what is broadcast.  Beyond the bound more
unique rows take the shuffle; the result is the same.  Groups are counted with partial sums
before any shuffle, so a group of any size needs no large task.

Texts are equal when identical after lower-casing A-Z.  A null text counts as empty; empty texts
are one group.  The largest id of a group stays, null ids last; of rows that repeat both id
and text one stays.  Input columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.staging import stage
from tavola.llm.textsql import lower_ascii

BITS_PER_ROW = 16
MAX_LOG_BITS = 30
PROBES = 2
_SEGMENT = 32768


def _position(h: Column, probe: int, bits: int) -> Column:
    """Position from 1; probe 0 takes the hash itself."""
    return F.pmod(h if not probe else F.xxhash64(h, F.lit(probe)), F.lit(bits).cast("long")) + 1


def position_filter(hashes: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """(segment, bitmap) of the positions that ``least`` or more rows of ``hashes`` (column h) have."""
    at = hashes.select(F.explode(F.array(*[_position(F.col("h"), k, bits) for k in range(PROBES)])).alias("at"))
    twice = at.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    placed = twice.select(F.expr("bitmap_bucket_number(at)").alias("segment"), F.expr("bitmap_bit_position(at)").alias("bit"))
    return placed.repartition("segment").groupBy("segment").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def maybe_in(rows: DataFrame, seen: DataFrame, bits: int) -> DataFrame:
    """``rows`` (column h) with the flag ``maybe``, looked up in the broadcast filter."""
    flag = F.lit(True)
    for k in range(PROBES):
        part = F.broadcast(seen.select(F.col("segment").alias(f"segment{k}"), F.col("bitmap").alias(f"bitmap{k}")))
        rows = rows.withColumn(f"at{k}", _position(F.col("h"), k, bits)).withColumn(f"s{k}", F.expr(f"bitmap_bucket_number(at{k})"))
        rows = rows.join(part, F.col(f"s{k}") == F.col(f"segment{k}"), "left")
        bit = f"bitmap_bit_position(at{k})"
        byte = f"cast(conv(hex(substring(bitmap{k}, cast({bit} div 8 + 1 as int), 1)), 16, 10) as int)"
        flag = flag & F.coalesce(F.expr(f"shiftright({byte}, cast({bit} % 8 as int)) % 2 = 1"), F.lit(False))
    rows = rows.withColumn("maybe", flag)
    return rows.drop(*[f"{c}{k}" for k in range(PROBES) for c in ("at", "s", "segment", "bitmap")])


def filter_bits(rows: int) -> int:
    return 1 << min(MAX_LOG_BITS, max(15, (BITS_PER_ROW * rows).bit_length()))


def mark_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    same = lower_ascii(F.col(text))
    rows = docs.select(F.col(id).alias("doc_id"), F.sha2(same, 256).alias("sha"), F.xxhash64(same).alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = stage(rows, "digests")  # places are fixed from here on
    bits = filter_bits(rows.count())
    rows = maybe_in(rows, stage(position_filter(rows.select("h"), bits), "filter"), bits)
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    # of the rows with the largest id (null if all are) the one of the first place stays
    some = rows.where("maybe")
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("place")).alias("back"))).alias("top")
    group = some.groupBy("sha").agg(first, F.count("*").alias("group_size"))
    found = some.join(group.select("sha", F.col("top.doc_id").alias("keep_id"), F.col("top.back").alias("back"), "group_size"), "sha")
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("place") == -F.col("back")).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """The rows of ``docs`` that stay, with all their columns; rows that are surely unique never shuffle."""
    same = lower_ascii(F.col(text))
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("id"), same.alias("same")).withColumn("h", F.xxhash64("same"))
    bits = filter_bits(docs.count())
    rows = maybe_in(rows, stage(position_filter(rows.select("h"), bits), "filter"), bits)
    some = rows.where("maybe").select("row", "id", F.sha2("same", 256).alias("sha"))
    stay = some.groupBy("sha").agg(F.max("id").alias("keep"))
    found = some.join(stay.withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep")), "left_semi").dropDuplicates(["sha", "id"])
    return rows.where("not maybe").select("row").union(found.select("row")).select("row.*")
