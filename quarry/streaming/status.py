"""Statuses of which only changes are told: of stored rows, and of streams while they run."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

STATUS = "query string, state string, batches long, rows long, failure string"


def changed(rows: DataFrame, key: str, order: tuple[str, ...], state: str) -> DataFrame:
    """The rows whose state differs from that of the row before, by key; the first row of a key is a change, and a null state is one of its own. `order` should tell all rows of a key apart."""
    back = Window.partitionBy(key).orderBy(*order)
    first, before = F.row_number().over(back) == 1, F.lag(state).over(back)
    return rows.withColumn("_new", first | ~F.col(state).eqNullSafe(before)).filter("_new").drop("_new")


class StatusListener(StreamingQueryListener):
    """Tells `sink` the STATUS of each streaming query of a session when it is another than before: as it starts, after micro-batches that had rows, as it ends or fails.

    Batches and rows are counted from the start of the run. Calls come from Spark's listener thread, one at a time; an idle stream says nothing.
    """

    def __init__(self, sink: Callable[[dict], None]):
        self.sink, self.told, self.lock = sink, {}, threading.Lock()

    def tell(self, run: str, **new) -> None:
        with self.lock:
            old = self.told.get(run, {"query": None, "state": "running", "batches": 0, "rows": 0, "failure": None})
            status = {**old, **new, "batches": old["batches"] + new.get("batches", 0), "rows": old["rows"] + new.get("rows", 0)}
            if run not in self.told or status != old:
                self.sink(status)
            if status["state"] == "running":
                self.told[run] = status
            else:
                self.told.pop(run, None)  # nothing is kept of runs that are over

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.tell(str(event.runId), query=event.name or str(event.id))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if p.numInputRows > 0:
            self.tell(str(p.runId), query=p.name or str(p.id), batches=1, rows=int(p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.tell(str(event.runId), state="failed" if event.exception else "ended", failure=event.exception)


def listened(spark: SparkSession, sink: Callable[[dict], None]) -> Callable[[], None]:
    """Adds a StatusListener for all streams of the session; the function that comes back takes it away."""
    listener = StatusListener(sink)
    spark.streams.addListener(listener)
    return lambda: spark.streams.removeListener(listener)


def server_event(status: dict) -> str:
    """A status as a server-sent event."""
    return f"data: {json.dumps(status, ensure_ascii=False)}\n\n"
