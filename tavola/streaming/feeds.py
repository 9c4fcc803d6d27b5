"""Structured Streaming versions of the change-driven rules.

Sources are parquet file streams over the driver tables (``readStream`` with the
batch schema).  Each stream has a batch twin in ``tavola.operators.changes``;
``run_to_table`` drives a stream to completion (``availableNow``) into a parquet
sink under the session's checkpoint folder and returns the sink as a batch
DataFrame, so stream and twin can be compared row for row.

Stateful logic (table status from order and reservation changes) uses
``transformWithStateInPandas`` keyed by table: a value state for the table and a
map state of its orders' last statuses (RocksDB state store), which orders leave some time after they
were closed; events older than the table's last applied event are late and are not applied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tavola.operators import changes as C
from tavola.operators.staged import new_folder
from tavola.session import ensure_checkpoint_dir
from tavola.sources.domain import Domain


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream over one driver table; ``max_files`` bounds the files of a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(f"{sf_dir}/{name}*.parquet")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store (which ``transformWithState`` needs) for queries started inside; the caller's setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "append", base: str | None = None) -> DataFrame:
    """Run ``stream`` until the source is drained; return what the sink received.

    Checkpoint and sink live under ``spark.checkpoint.dir`` (shared storage on a
    cluster), in a fresh folder per run, or in ``base``, to go on with an earlier run.
    """
    base = base or ensure_checkpoint_dir(spark).rstrip("/") + f"/tavola-streams/{name}-{uuid.uuid4().hex}"
    if output_mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
        schema = stream.schema
    else:  # update / complete: keep every version of a row with its batch

        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

        writer = stream.writeStream.foreachBatch(sink)
        schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    with rocksdb_state(spark):  # read when the query starts
        query = writer.option("checkpointLocation", f"{base}/chk").outputMode(output_mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


# ------------------------------------------------------------------ I1 / I2
LOG_SCHEMA = "table_id long, old_status string, new_status string, changed_at timestamp_ntz, seq long, changed_by string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("closed", "cancelled")


#: How long an order stays in the state after it was closed or cancelled, and how late an event may come, in event time.
KEEP_DAYS, LATE = 60, "1 day"
HOUR_MS = 3_600_000


class TableStatusProcessor(StatefulProcessor):
    """Per table: the table's status, the last applied (time, seq), and a map order -> last status and its time.

    Events of a micro-batch are applied in (time, seq) order.  An event not newer
    than the last applied one is late and is skipped (it would rewrite history).
    Order events change the table only on the trigger transitions; reservation
    inserts set it to reserved.  The map state keeps one small entry per order
    seen at the table (per-key entries in RocksDB, never one big value).

    State ends: a closed or cancelled order sets an event-time timer, rounded up to the hour, at which the
    watermark takes it out of the map.  An order that changes ``keep_days`` or more after it was closed is
    taken as a new one.
    """

    def __init__(self, keep_days: float = KEEP_DAYS):
        self.keep_ms = int(keep_days * 24 * HOUR_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("table", "status string, at_us long, seq long")
        self.orders = handle.getMapState("orders", "order_key long", "status string, at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["changed_at", "seq"], kind="stable")
        status, at_us, seq = self.table.get() if self.table.exists() else (None, None, None)
        # one state read and one write per order of this micro-batch
        touched: dict[int, tuple[str, int] | None] = {}
        for ok in pdf["order_key"].dropna().unique().tolist():
            k = (int(ok),)
            touched[int(ok)] = self.orders.getValue(k) if self.orders.containsKey(k) else None
        changed: set[int] = set()
        out = []
        for row in pdf.itertuples(index=False):
            us, sq = int(pd.Timestamp(row.changed_at).value // 1000), int(row.seq)
            if at_us is not None and (us, sq) <= (at_us, seq):
                continue  # late
            at_us, seq = us, sq
            if row.order_status is None or pd.isna(row.order_status):
                new = "reserved"
            else:
                ok = int(row.order_key)
                prev = touched[ok][0] if touched.get(ok) else None
                touched[ok] = (row.order_status, us)
                changed.add(ok)
                if row.order_status == "open" and prev is None:  # inserted as open
                    new = "occupied"
                elif row.order_status in TERMINAL and prev is not None and prev not in TERMINAL:
                    new = "available"
                else:
                    new = None
            if new is None:
                continue
            old = status if status is not None else row.initial_status
            if old != new:
                out.append((int(row.table_id), old, new, row.changed_at, sq, row.changed_by))
            status = new
        due = set()
        for ok in changed:
            self.orders.updateValue((ok,), touched[ok])
            if touched[ok][0] in TERMINAL:
                due.add(-(-(touched[ok][1] // 1000 + self.keep_ms) // HOUR_MS) * HOUR_MS)
        for at_ms in due:
            self.handle.registerTimer(at_ms)
        self.table.update((status, at_us, seq))
        if out:
            yield pd.DataFrame(out, columns=["table_id", "old_status", "new_status", "changed_at", "seq", "changed_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = (expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms) * 1000
        gone = [k for k, (status, at_us) in self.orders.iterator() if status in TERMINAL and at_us <= limit]
        for k in gone:
            self.orders.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def status_log_stream(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, keep_days: float = KEEP_DAYS, late: str = LATE) -> DataFrame:
    """I1/I2 as a stream: events -> per-table state (table status + order statuses) -> log of real changes.

    Start it inside ``rocksdb_state(spark)`` unless the session uses the RocksDB state store already; ``run_to_table`` does.
    """
    d = Domain(spark, sf_dir)
    n = d.dining_tables.count()  # one small count: the feed's table key is user_id % n
    e = events if events is not None else stream_table(spark, sf_dir, "events")
    feed = e.where(F.col("event_type").isin(*C.ORDER_EVENT_STATUS, "signup")).select(
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("order_key"),
        (F.col("user_id") % F.lit(n)).alias("table_id"),
        F.col("ts").alias("changed_at"),
        F.col("event_id").alias("seq"),
        C.order_event_status(F.col("event_type")).alias("order_status"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("changed_by"),
        C.instant_of(F.col("ts")).alias("event_time"),
    ).withWatermark("event_time", late)
    tables = d.dining_tables.select("table_id", F.lower("status").alias("initial_status"))
    enriched = feed.join(tables, "table_id", "left")  # stream-static join
    return enriched.groupBy("table_id").transformWithStateInPandas(
        statefulProcessor=TableStatusProcessor(keep_days), outputStructType=LOG_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def table_state_from_log(d: Domain, log: DataFrame) -> DataFrame:
    """I1 from the stream's log: the last logged status per table, else the stored status."""
    last = log.groupBy("table_id").agg(F.max_by(F.struct("new_status", "changed_at"), F.struct("changed_at", "seq")).alias("l"))
    t = d.dining_tables.select("table_id", F.lower("status").alias("initial_status"))
    return t.join(last, "table_id", "left").select(
        "table_id", F.coalesce("l.new_status", "initial_status").alias("status"), F.col("l.changed_at").alias("last_log_at")
    )


# ---------------------------------------------------------------------- I3
def feed_folder(df: DataFrame, name: str) -> DataFrame:
    """A table written below the checkpoint folder and read as a file stream (a change log as a source)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def reservation_completions_stream(changes: DataFrame, reservations: DataFrame, late: str = LATE, days: int = C.COMPLETION_DAYS) -> DataFrame:
    """I3 as a stream-stream join of the order change log and the reservations, each with its watermark.

    A reservation waits ``days`` days of event time for its order to close; a closing waits ``late`` for its
    reservation.  After that the join forgets them.
    """
    c = changes.withColumn("closed_at", C.instant_of(F.col("changed_at"))).withWatermark("closed_at", late)
    r = reservations.withColumn("made_at", C.instant_of(F.col("created_at"))).withWatermark("made_at", late)
    return C.completions(c, r, days)


def completions_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    stream = reservation_completions_stream(
        feed_folder(C.order_changes(d), "order-changes"), feed_folder(d.reservations.select("reservation_id", "status", "created_at"), "reservations")
    )
    return run_to_table(spark, stream, "completions")


# ---------------------------------------------------------------------- I4
def price_snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    lines = Domain.map_lineitem(stream_table(spark, sf_dir, "lineitem"))
    return C.apply_price_snapshot(C.incoming_lines(d, lines), d.menu_items)


# ---------------------------------------------------------------------- I7
def maintenance_reject_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    n = d.dining_tables.count()
    req = Domain.map_view_requests(stream_table(spark, sf_dir, "events"), F.lit(n))
    return C.maintenance_reject(d, req)


# ---------------------------------------------------------------------- I6
def hourly_activity_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """Hourly activity with an event-time watermark (zone-less timestamps are cast first)."""
    e = stream_table(spark, sf_dir, "events").withColumn("ts", C.instant_of(F.col("ts")))
    return C.activity_aggregate(e.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")))


# ------------------------------------------------------- registered queries
def _final_update_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Latest emitted version of each key (update mode writes a key again when it changes)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_batch").alias("r")).select(
        *keys, "r.*").drop("_batch")


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_status_log": lambda spark, sf: run_to_table(spark, status_log_stream(spark, sf), "status_log"),
        "stream_reservation_completions": completions_to_table,
        "stream_price_snapshot": lambda spark, sf: run_to_table(spark, price_snapshot_stream(spark, sf), "price_snapshot"),
        "stream_maintenance_reject": lambda spark, sf: run_to_table(spark, maintenance_reject_stream(spark, sf), "maintenance"),
        "stream_hourly_activity": lambda spark, sf: _final_update_rows(
            run_to_table(spark, hourly_activity_stream(spark, sf), "hourly", output_mode="update"), ["window_start"]
        ),
    }
