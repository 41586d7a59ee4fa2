"""File-change streams: coalescing, windowed counts, duplicate suppression, priorities, micro-batch ingestion.

Every function takes a batch or a streaming DataFrame of (file_path, event_type, ts) unless it says otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..operators.ingest import EXTENSIONS
from ..session import shared_folder

# Quiet time before a change is acted on, queue capacity, retained results.
QUIET = "2 seconds"
CAPACITY, KEPT_DONE, KEPT_FAILED, URGENT = 1_000, 100, 50, 1_000
#: File events that wait at most; more are dropped, the oldest first kept.
WAITING = 100
WATERMARK = "10 minutes"


def split_moves(events: DataFrame) -> DataFrame:
    """Moves (with a column target) as a deletion of the old path and a creation of the new one."""
    pair = F.when(F.col("event_type") == "moved", F.array(F.struct(F.col("file_path"), F.lit("deleted").alias("event_type")), F.struct(F.col("target").alias("file_path"), F.lit("created").alias("event_type")))).otherwise(F.array(F.struct("file_path", "event_type")))
    return events.select(F.explode(pair).alias("e"), "ts").select("e.file_path", "e.event_type", "ts")


def coalesce(events: DataFrame, quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """One row for each burst of events of a path (no longer gap than `quiet`): the last event counts.

    On a stream give a watermark: bursts are emitted once it has passed them, later events are dropped.
    """
    timed = events.withWatermark("ts", watermark) if watermark else events
    # Of events at the same time the one with the larger id counts, without ids the alphabetically last.
    last = F.struct("ts", *(["event_id"] if "event_id" in events.columns else []), "event_type")
    bursts = timed.groupBy("file_path", F.session_window("ts", quiet).alias("w")).agg(F.max_by("event_type", last).alias("event_type"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return bursts.select("file_path", "event_type", "last_ts", "events")


def window_counts(events: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    timed = events.withWatermark("ts", watermark) if watermark else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_type", "events")


def first_of_content(changes: DataFrame, watermark: str | None = None) -> DataFrame:
    """(file_path, file_hash, ts) without repeats of the same content of a file."""
    if watermark:
        return changes.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["file_path", "file_hash"])
    return changes.groupBy("file_path", "file_hash").agg(F.min("ts").alias("ts"))


def priority(size_bytes: Column, age_hours: Column, active: Column, change: Column, user_requested: Column) -> Column:
    """0 to 1000; requests of users are urgent, then sessions, recency, small files and small changes count."""
    part = lambda c: F.floor(F.greatest(F.lit(0.0), c))
    score = F.when(active, 200).otherwise(0) + part(400 - age_hours * 10) + part(200 - size_bytes / 1048576.0 * 2) + part((1 - change) * 200)
    return F.when(user_requested, URGENT).otherwise(F.least(F.lit(URGENT), F.greatest(F.lit(0), score))).cast("int")


def queue(tasks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tasks (file_path, priority, enqueued_at) in the order they are taken: the latest of each path. A full queue refuses newcomers: the `capacity` paths that came first are in it."""
    return latest(tasks).orderBy("_came", "file_path").limit(capacity).select("t.*").orderBy(F.desc("priority"), "enqueued_at", "file_path")


def latest(tasks: DataFrame) -> DataFrame:
    """The latest task of each path as t, and when the path first came."""
    return tasks.groupBy("file_path").agg(F.max_by(F.struct(*tasks.columns), F.struct("enqueued_at", "priority")).alias("t"), F.min("enqueued_at").alias("_came"))


def queue_status(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")))


def retained(results: DataFrame, done: int = KEPT_DONE, failed: int = KEPT_FAILED) -> DataFrame:
    """The latest results (task_id, status, completed_at): so many completed, so many failed; other rows stay.

    Each status is a top-k that is cut in every task before anything is gathered, so a status with most of the rows fills no task.
    """
    rest = results.filter(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False)))
    latest = lambda s, n: results.filter(F.col("status") == s).orderBy(F.desc("completed_at"), F.desc("task_id")).limit(n)
    return rest.unionAll(latest("completed", done)).unionAll(latest("failed", failed))


def accepted(events: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Events of files that can be ingested (deletions of any), moves split first."""
    split = split_moves(events) if "target" in events.columns else events
    return split.filter((F.col("event_type") == "deleted") | suffix(F.col("file_path")).isin(*extensions))


def waiting(events: DataFrame, capacity: int = WAITING) -> DataFrame:
    """The events that a full queue of so many does not drop: the first to come (a batch)."""
    return events.orderBy("ts", "file_path", "event_type").limit(capacity)


def taken(tasks: DataFrame, n: int) -> DataFrame:
    """Tasks (file_path, priority, enqueued_at, state) after the n most urgent pending ones were taken: they become active. What is pending is in the queue already, so nothing is refused here."""
    first = latest(tasks.filter("state = 'pending'")).select("t.*").orderBy(F.desc("priority"), "enqueued_at", "file_path").limit(n).select(F.col("file_path").alias("_p"), F.lit(True).alias("_t"))
    state = F.when(F.col("_t") & (F.col("state") == "pending"), "active").otherwise(F.col("state"))
    return tasks.join(F.broadcast(first), F.col("file_path") == F.col("_p"), "left").withColumn("state", state).drop("_p", "_t")  # at most n rows


def active(tasks: DataFrame) -> DataFrame:
    """What is being worked on, by time."""
    return tasks.filter("state = 'active'").orderBy("enqueued_at", "file_path")


def enqueued(files: DataFrame, as_of: str, user_requested: bool = False) -> DataFrame:
    """Tasks (file_path, priority, enqueued_at, state) of files (file_path, file_size, last_modified)."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("last_modified")) / 3600.0
    p = priority(F.col("file_size"), age, F.lit(False), F.lit(1.0), F.lit(user_requested))
    return files.select("file_path", p.alias("priority"), F.to_timestamp(F.lit(as_of)).alias("enqueued_at"), F.lit("pending").alias("state"))


def status_changes(statuses: Iterator[dict]) -> Iterator[dict]:
    """Of a sequence of queue states only those that differ from the one before."""
    last = None
    for s in statuses:
        if s != last:
            yield s
        last = s


def not_in_flight(events: DataFrame, in_flight: DataFrame) -> DataFrame:
    return events.join(in_flight.select("file_path"), "file_path", "left_anti")


def file_stream(spark: SparkSession, directory: str, files_per_trigger: int = 10) -> DataFrame:
    """New files of a directory as a stream of binaryFile rows."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(directory)


def ingest_stream(events: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, once: bool = True):
    """Runs apply(upserts, deletions) on each micro-batch of coalesced events."""

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("file_path").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type"))
        apply(last.filter("event_type <> 'deleted'").select("file_path"), last.filter("event_type = 'deleted'").select("file_path"))

    stateful = events.isStreaming and "transformWithState" in events._jdf.queryExecution().analyzed().toString()
    writer = events.writeStream.foreachBatch(batch).outputMode("update" if stateful else "append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available now into tables of the shared checkpoint folder and returns its rows as a batch.

    Each micro-batch is a folder of its own, overwritten if it is repeated; in complete mode the last one counts.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/{k}")
        batches.append(k)

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    done = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{root}/rows/{k}" for k in done]) if done else spark.createDataFrame([], stream.schema)
