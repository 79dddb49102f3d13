"""Intraday (streaming) counterparts of the batch build (tier R).

* ``stream_events_clean``: the export read as a file stream, event time from the
  microsecond timestamp, watermark, duplicates dropped within the watermark.
* ``stream_session_rollup``: gap-based sessions per user with ``session_window``,
  emitted in append mode once the watermark closes them; ``open_sessions`` are those that a
  finite input leaves open, from the events after each user's last emitted session.
* ``daily_overrides_intraday``: a finished daily export replaces the intraday rows
  of the same day (left anti join on event_date + union).
* ``append_batch`` / ``read_appended``: a ``foreachBatch`` sink that keeps each
  micro-batch in a folder of its own, so that a repeated batch replaces itself and no other
  rows, and the table read back with each event once.

* ``replay_days``: a stored export fed to one stream day by day in event order, so that a day's
  watermark is enough and the state holds the events of a day or two, not those of the window.

Files of a backlog arrive in the order they were written, not in event order. The
watermark is a parameter: a live stream takes how late an event may be, a replay a day, and a
backlog read as it lies the whole span of its days (``backlog_watermark``). A run fails if the
watermark made it drop a row.

Checkpoints and outputs go under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathweave.schema import RAW_EVENT
from pathweave.session import checkpoint_dir
from pathweave.sources.store import _fs_status

DEDUP_KEYS = ["user_pseudo_id", "event_name", "event_timestamp", "event_id"]
LIVE_WATERMARK = "2 hours"
REPLAY_WATERMARK = "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches of a run whose progress is kept, to count the rows dropped as late.
KEPT_PROGRESS = 1_000_000


class LateRowsDropped(RuntimeError):
    """A stateful operator dropped rows behind the watermark."""


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("basePath", path).parquet(path))


def backlog_watermark(window_days: int) -> str:
    """A watermark that no event of a backlog of so many days can fall behind."""
    return f"{window_days + 1} days"


def stream_events_clean(stream: DataFrame, watermark: str = LIVE_WATERMARK) -> DataFrame:
    ev = stream.where(F.col("user_pseudo_id").isNotNull()).withColumn(
        "event_ts", F.timestamp_micros("event_timestamp"))
    return ev.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(DEDUP_KEYS)


def stream_session_rollup(clean: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Per user, events closer than ``gap`` form one session (streaming or batch)."""
    return clean.groupBy("user_pseudo_id", F.session_window("event_ts", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_timestamp").alias("start_us"), F.max("event_timestamp").alias("end_us"),
        F.count_if(F.col("event_name") == "purchase").alias("purchases"))


def run_available_now(df: DataFrame, name: str, output_mode: str = "append",
                      state_partitions: int | None = None) -> DataFrame:
    """Run a streaming query over everything available, into Parquet under the
    checkpoint folder; return the written result as a batch DataFrame.

    Raises LateRowsDropped if a stateful operator dropped rows behind the watermark.

    A stateful stream keeps the shuffle-partition count of its first start for its
    whole life (it is stored in the checkpoint).  ``state_partitions`` (default: the
    cluster's default parallelism) is applied only while the query starts; the
    session settings are restored right after."""
    spark = df.sparkSession
    root = os.path.join(checkpoint_dir(spark), "pathweave-streams", name)
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.numRecentProgressUpdates": str(KEPT_PROGRESS)}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
        q.awaitTermination()
        late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    if late:
        raise LateRowsDropped(f"{late} rows of {name} came behind the watermark; widen it")
    return spark.read.schema(df.schema).parquet(out)


@dataclass
class Replayed:
    """What a replay wrote, the most rows that its state held after a batch, and the rows it was fed."""

    rows: DataFrame
    most_state_rows: int
    rows_in: int


def replay_days(export: DataFrame, days: list[str], make: Callable[[DataFrame], DataFrame], name: str,
                state_partitions: int | None = None) -> Replayed:
    """Feed ``days`` of an export, in their order, to the one stream ``make(events)`` and run it over them.

    Each day's rows are appended to a log folder that the stream reads, and the next day follows once
    they have been processed. State is kept in RocksDB, off the heap; log, checkpoint and output
    lie under the checkpoint folder. A replay of the same name goes on where it was stopped: days in its log are not
    appended again, and the stream knows which files it has read. Raises LateRowsDropped as ``run_available_now``.
    """
    spark = export.sparkSession
    root = os.path.join(checkpoint_dir(spark), "pathweave-streams", name)
    log, out = os.path.join(root, "log"), os.path.join(root, "out")

    def append(day: str) -> None:
        if _fs_status(spark, f"{log}/day={day}/_SUCCESS") is None:
            export.where(F.col("event_date") == day).write.mode("overwrite").parquet(f"{log}/day={day}")

    append(days[0])
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # the next day moves the watermark
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = make(spark.readStream.schema(export.schema).parquet(f"{log}/day=*"))
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/ckpt").outputMode("append").start())
    finally:  # the query has its own copy
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batches: dict[int, tuple[int, int, int]] = {}  # rows in, rows dropped as late, rows of state

    def note() -> None:
        for p in q.recentProgress:
            batches[p.batchId] = (p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators),
                                  sum(op.numRowsTotal for op in p.stateOperators))

    try:
        for day in days:
            append(day)
            q.processAllAvailable()
            note()
    finally:
        q.stop()
        note()  # a batch is reported after it has been processed
    fed, late, held = ([b[i] for b in batches.values()] for i in range(3))
    if sum(late):
        raise LateRowsDropped(f"{sum(late)} rows of {name} came behind the watermark; widen it")
    return Replayed(spark.read.schema(stream.schema).parquet(out), max(held, default=0), sum(fed))


def open_sessions(events: DataFrame, emitted: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a finite input that a stream hasn't ``emitted``: of the events after each user's last one that it has.

    A user's sessions are emitted in order, so these are the events of open sessions and no others."""
    last = emitted.groupBy("user_pseudo_id").agg(F.max("end_us").alias("_done"))
    tail = events.where(F.col("user_pseudo_id").isNotNull()).join(last, "user_pseudo_id", "left").where(
        F.col("_done").isNull() | (F.col("event_timestamp") > F.col("_done"))).drop("_done")
    tail = tail.dropDuplicates(DEDUP_KEYS).withColumn("event_ts", F.timestamp_micros("event_timestamp"))
    return stream_session_rollup(tail, gap)


def daily_overrides_intraday(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    """Daily rows plus intraday rows of days that have no daily export yet."""
    days = daily.select("event_date").distinct()
    return daily.unionByName(intraday.join(days, "event_date", "left_anti"))


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch body: the rows of a micro-batch go to a folder of its own.

    A batch that is run again after a failure replaces its own folder; a day whose
    files span several batches, or a late file for an old day, takes nothing away.
    """
    batch.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The table of append_batch with each event once, however many batches brought it."""
    rows = spark.read.schema(RAW_EVENT).option("basePath", path).parquet(f"{path}/batch_id=*")
    return rows.select(*RAW_EVENT.fieldNames()).dropDuplicates(DEDUP_KEYS)


def incremental_append(stream: DataFrame, name: str) -> DataFrame:
    """Append everything available in a raw event stream to the table ``name`` and read it back."""
    spark = stream.sparkSession
    root = os.path.join(checkpoint_dir(spark), "pathweave-streams", name)
    q = (stream.writeStream.foreachBatch(lambda b, i: append_batch(b, i, f"{root}/table"))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_appended(spark, f"{root}/table")


def touched_users(added: DataFrame) -> DataFrame:
    """Users with rows in ``added``, the events of new or late files alone."""
    return added.where(F.col("user_pseudo_id").isNotNull()).select("user_pseudo_id").distinct()


def incremental_sessions(stored: DataFrame, events: DataFrame, touched: DataFrame, build) -> DataFrame:
    """A session table brought up to date: rows of ``touched`` users are built anew from ``events``, others stay.

    ``build`` makes session rows from raw events. Only the events of touched users are read by it."""
    fresh = build(events.join(touched, "user_pseudo_id", "left_semi"))
    return stored.join(touched, "user_pseudo_id", "left_anti").unionByName(fresh)
