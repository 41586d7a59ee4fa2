"""Debouncing by timers and the update queue, on running streams that are stopped and started again."""

import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from quarry.streaming import events as ev
from quarry.streaming import stateful as sf

EVENTS = "file_path string, event_type string, ts timestamp"


class Running:
    """A stream over a folder of files, and what came out of it."""

    def __init__(self, spark, folder, schema, work):
        self.spark, self.folder, self.schema, self.work, self.rows = spark, folder, schema, work, []
        (folder / "in").mkdir(exist_ok=True)

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def start(self):
        stream = self.work(self.spark.readStream.schema(self.schema).parquet(str(self.folder / "in")))
        writer = stream.writeStream.foreachBatch(lambda df, _: self.rows.extend(df.collect())).outputMode("update").option("checkpointLocation", str(self.folder / "checkpoint"))
        self.query = writer.trigger(processingTime="200 milliseconds").start()

    def wait(self, n, seconds=60):
        end = time.time() + seconds
        while len(self.rows) < n and time.time() < end and self.query.isActive:
            time.sleep(0.1)
        assert len(self.rows) >= n, (self.rows, self.query.exception())

    def idle(self):
        self.query.processAllAvailable()

    def stop(self):
        self.query.stop()
        self.query.awaitTermination()


def at(second):
    return datetime(2024, 1, 1, 0, 0, second)


def test_bursts_come_out_by_themselves_and_survive_a_restart(spark, tmp_path):
    run = Running(spark, tmp_path, EVENTS, lambda s: sf.debounced(s, 1500))
    run.put(("a", "created", at(1)), ("a", "modified", at(2)), ("b", "deleted", at(3)))
    run.start()
    run.wait(2)  # nothing else is sent
    assert sorted((r.file_path, r.event_type, r.last_ts, r.events) for r in run.rows) == [("a", "modified", at(2), 2), ("b", "deleted", at(3), 1)]
    run.stop()

    later = Running(spark, tmp_path, EVENTS, lambda s: sf.debounced(s, 20_000))
    later.put(("a", "deleted", at(9)), ("a", "created", at(8)))
    later.start()
    while later.query.lastProgress is None or not any(p["numInputRows"] for p in later.query.recentProgress):
        time.sleep(0.1)
    later.stop()  # within the quiet time
    assert not later.rows
    again = Running(spark, tmp_path, EVENTS, lambda s: sf.debounced(s, 20_000))
    again.start()
    again.wait(1)
    assert [(r.file_path, r.event_type, r.events) for r in again.rows] == [("a", "deleted", 2)]
    again.stop()


def command(seq, what, path=None, priority=None, n=None, message=None, queue="q"):
    return (queue, seq, what, path, priority, n, message)


def test_queue_lives_through_restarts(spark, tmp_path):
    open_queue = lambda: Running(spark, tmp_path, sf.COMMANDS, lambda s: sf.queued(s, capacity=3, done=2, failed=1))
    told = lambda run: [(r.seq, r.outcome, r.file_path, r.message) for r in sorted(run.rows, key=lambda r: (r.seq is None, r.seq or 0, r.file_path or "")) if r.outcome != "status"]
    status = lambda run: [(r.pending, r.processing, r.completed, r.failed) for r in run.rows if r.outcome == "status"]
    run = open_queue()
    run.put(command(1, "enqueue", "a", 10), command(2, "enqueue", "b", 900), command(3, "enqueue", "c", 10), command(4, "enqueue", "d", 1000), command(5, "enqueue", "a", 20), command(1, "enqueue", "z", 1, queue="other"))
    run.start()
    run.idle()
    run.stop()
    assert [x for x in told(run) if x[2] != "z"] == [(1, "accepted", "a", None), (2, "accepted", "b", None), (3, "accepted", "c", None), (4, "refused", "d", "full"), (5, "changed", "a", None)]
    assert sorted(status(run)) == [(1, 0, 0, 0), (3, 0, 0, 0)]

    run = open_queue()
    run.put(command(6, "take", n=2), command(7, "enqueue", "b", 5), command(8, "fail", "b", message="broken"), command(9, "complete", "a"), command(10, "complete", "nobody"))
    run.start()
    run.idle()
    run.stop()
    assert told(run) == [(6, "taken", "a", None), (6, "taken", "b", None), (7, "refused", "b", "being worked on"), (8, "failed", "b", "broken"), (9, "completed", "a", None), (10, "unknown", "nobody", "complete")]
    assert status(run) == [(1, 0, 1, 1)]

    run = open_queue()
    run.put(command(11, "retry", "b"), command(12, "take", n=5), command(13, "complete", "b"), command(14, "complete", "c"), command(15, "enqueue", "y", 1), command(16, "clear"), command(17, "dance"))
    run.start()
    run.idle()
    run.stop()
    assert [x[1:3] for x in told(run)] == [("accepted", "b"), ("taken", "b"), ("taken", "c"), ("completed", "b"), ("completed", "c"), ("accepted", "y"), ("dropped", "y"), ("unknown", None)]
    assert status(run) == [(0, 0, 2, 0)]  # of three completed two are kept


def test_batch_queue_refuses_newcomers(spark):
    rows = [(f"f{k}", k, k) for k in range(30)] + [("f2", 99, 40)]
    random.Random(1).shuffle(rows)
    got = ev.queue(spark.createDataFrame(rows, "file_path string, priority int, enqueued_at long"), 10).collect()
    assert [r["file_path"] for r in got] == ["f2", *(f"f{k}" for k in (9, 8, 7, 6, 5, 4, 3, 1, 0))]


def test_workspace_waits_for_quiet(spark, tmp_path):
    from quarry.plans.workspace import Workspace

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("words")
    (tmp_path / "events").mkdir()
    w = Workspace(spark, str(tmp_path / "tables"))
    w.open(str(docs), "2024-01-01 00:00:00")
    (docs / "b.txt").write_text("more words")
    rows = [(str(docs / "b.txt"), "deleted", at(1)), (str(docs / "b.txt"), "created", at(2)), (str(docs / "a.txt"), "deleted", at(3))]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    w.watch(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), str(tmp_path / "checkpoint"), lambda: "2024-02-01 00:00:00", quiet_ms=500)
    names = lambda: {r["file_path"].rsplit("/", 1)[1] for r in w.table("documents").filter(F.col("processing_status") == "indexed").collect()}
    end = time.time() + 90
    while names() != {"b.txt"} and time.time() < end:
        time.sleep(0.5)
    w.stop()
    assert names() == {"b.txt"}
