"""Streams with state of their own: debouncing with timers, and an update queue that survives a restart.

State and timers are Spark's (`transformWithState` on RocksDB), so they are in the checkpoint: whoever restarts a query finds what was waiting. One key is one path, or one queue; a queue's state is bounded by
its capacity and by how many results it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .events import CAPACITY, KEPT_DONE, KEPT_FAILED

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds without an event of a path before its burst is told.
QUIET_MS = 2_000
BURSTS = "file_path string, event_type string, last_ts timestamp, events long"
COMMANDS = "queue string, seq long, command string, file_path string, priority int, n int, message string"
OUTCOMES = "queue string, seq long, outcome string, file_path string, priority int, message string, pending long, processing long, completed long, failed long"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class Debounce(StatefulProcessor):
    """The last event of a path and how many there were, once nothing has come for `quiet_ms`."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "event_type string, last_ts timestamp, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kind, last, n = self.burst.get() if self.burst.exists() else (None, None, 0)
        for r in rows:
            if last is None or (r.ts, r.event_type) >= (last, kind):
                kind, last = r.event_type, r.ts
            n += 1
        self.burst.update((kind, last, n))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            kind, last, n = self.burst.get()
            self.burst.clear()
            yield Row(file_path=key[0], event_type=kind, last_ts=last, events=n)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """BURSTS of a stream (file_path, event_type, ts): each burst comes out by its own timer, without further events. `events.coalesce` is the same rule on a batch, by the events' own times.

    After a restart Spark looks at timers only when a source has something new; a source that ticks once a second, and whose rows are dropped, sees to that.
    """
    spark = prepared(events.sparkSession)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter("value < 0")
    ticks = ticks.select(F.lit("").alias("file_path"), F.lit("").alias("event_type"), F.col("timestamp").alias("ts"))
    return events.select("file_path", "event_type", "ts").unionByName(ticks).groupBy("file_path").transformWithState(Debounce(quiet_ms), BURSTS, "update", "processingTime")


class UpdateQueue(StatefulProcessor):
    """Commands of a queue in the order of seq.

    enqueue is refused if the path is being worked on or the queue is full, whatever the priority; a path that waits already only changes its priority. take makes the n most urgent tasks active (then the
    earliest, then by path); complete and fail end an active task; retry puts a failed one back, clear forgets all that waits. The latest results are kept, so many completed, so many failed.
    A row tells the outcome of each command; a row `status` follows a batch if the numbers have changed.
    """

    def __init__(self, capacity: int, done: int, failed: int):
        self.capacity, self.kept = capacity, {"completed": done, "failed": failed}

    def init(self, handle) -> None:
        self.tasks = {s: handle.getMapState(s, "file_path string", "priority int, seq long, message string") for s in ("pending", "active", "completed", "failed")}
        self.told = handle.getValueState("told", "pending long, processing long, completed long, failed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # The state of a queue is small (capacity and kept results): it is read once a batch, and what has changed is written back.
        now = {s: {k[0]: tuple(v) for k, v in state.iterator()} for s, state in self.tasks.items()}
        before = {s: dict(t) for s, t in now.items()}
        for r in sorted(rows, key=lambda r: (r.seq, r.command or "", r.file_path or "")):
            for outcome, path, priority, message in self.run(now, r):
                yield self.row(key, r.seq, outcome, path, priority, message)
        for s, state in self.tasks.items():
            for path in before[s].keys() - now[s].keys():
                state.removeKey((path,))
            for path, task in now[s].items():
                if before[s].get(path) != task:
                    state.updateValue((path,), task)
        status = tuple(len(now[s]) for s in ("pending", "active", "completed", "failed"))
        if not self.told.exists() or tuple(self.told.get()) != status:
            self.told.update(status)
            yield self.row(key, None, "status", None, None, None, *status)

    def row(self, key, seq, outcome, path, priority, message, *status) -> Row:
        return Row(**dict(zip([c.split()[0] for c in OUTCOMES.split(", ")], (key[0], seq, outcome, path, priority, message, *(status or (None,) * 4)), strict=True)))

    def run(self, now: dict[str, dict], r: Row) -> Iterator[tuple]:
        pending, active, path = now["pending"], now["active"], r.file_path
        if r.command in ("enqueue", "retry"):
            priority = r.priority
            if r.command == "retry":
                if path not in now["failed"]:
                    yield "unknown", path, None, r.command
                    return
                priority = now["failed"][path][0] if priority is None else priority
            if path in active:
                yield "refused", path, priority, "being worked on"
            elif path in pending:
                pending[path] = (priority, pending[path][1], None)
                yield "changed", path, priority, None
            elif len(pending) >= self.capacity:
                yield "refused", path, priority, "full"
            else:
                now["failed"].pop(path, None) if r.command == "retry" else None
                pending[path] = (priority, r.seq, None)
                yield "accepted", path, priority, None
        elif r.command == "take":
            for taken in sorted(pending, key=lambda p: (-(pending[p][0] or 0), pending[p][1], p))[: r.n or 1]:
                active[taken] = pending.pop(taken)
                yield "taken", taken, active[taken][0], None
        elif r.command in ("complete", "fail"):
            if path not in active:
                yield "unknown", path, None, r.command
                return
            kind, other = ("completed", "failed") if r.command == "complete" else ("failed", "completed")
            priority = active.pop(path)[0]
            now[other].pop(path, None)
            now[kind][path] = (priority, r.seq, r.message)
            while len(now[kind]) > self.kept[kind]:
                del now[kind][min(now[kind], key=lambda p: (now[kind][p][1], p))]
            yield kind, path, priority, r.message
        elif r.command == "clear":
            for gone in sorted(pending):
                yield "dropped", gone, pending.pop(gone)[0], None
        else:
            yield "unknown", path, None, r.command

    def close(self) -> None:
        pass


def queued(commands: DataFrame, capacity: int = CAPACITY, done: int = KEPT_DONE, failed: int = KEPT_FAILED) -> DataFrame:
    """OUTCOMES of a stream of COMMANDS, a state for each queue."""
    prepared(commands.sparkSession)
    names = [c.split()[0] for c in COMMANDS.split(", ")]
    return commands.select(names).groupBy("queue").transformWithState(UpdateQueue(capacity, done, failed), OUTCOMES, "update", "none")
