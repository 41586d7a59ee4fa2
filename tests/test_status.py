"""Status changes of rows and of running streams."""

import time

import pytest

from quarry.streaming import status as st


def test_changes_of_rows(spark):
    rows = [(k, i, s) for k, states in (("a", ["x", "x", "y", None, None, "y", "x"]), ("b", [None, "x"]), (None, ["z", "z"])) for i, s in enumerate(states)]
    got = st.changed(spark.createDataFrame(rows, "k string, i int, s string").repartition(3), "k", ("i",), "s").collect()
    assert {tuple(r) for r in got} == {("a", 0, "x"), ("a", 2, "y"), ("a", 3, None), ("a", 5, "y"), ("a", 6, "x"), ("b", 0, None), ("b", 1, "x"), (None, 0, "z")} and len(got) == 8
    assert st.changed(spark.createDataFrame([], "k string, i int, s string"), "k", ("i",), "s").count() == 0


def told(spark, tmp_path, work):
    """What a listener hears of one stream over three files, a file a micro-batch."""
    place = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(place))
    heard = []
    stop = st.listened(spark, heard.append)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(place))
        run = stream.writeStream.queryName("ids").foreachBatch(work).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except Exception:  # noqa: S110  the listener tells
            pass
        until = time.time() + 20
        while time.time() < until and (not heard or heard[-1]["state"] == "running"):
            time.sleep(0.1)
    finally:
        stop()
    return heard


def test_a_running_stream_tells_its_changes(spark, tmp_path):
    heard = told(spark, tmp_path, lambda rows, k: rows.count())
    assert all(h["query"] == "ids" and h["failure"] is None for h in heard)
    assert [(h["state"], h["batches"], h["rows"]) for h in heard] == [("running", 0, 0), ("running", 1, 10), ("running", 2, 20), ("running", 3, 30), ("ended", 3, 30)]
    assert st.server_event(heard[0]) == 'data: {"query": "ids", "state": "running", "batches": 0, "rows": 0, "failure": null}\n\n'


def test_a_failed_stream_says_why(spark, tmp_path):
    def work(rows, k):
        if k == 1:
            raise ValueError("no room left")
        rows.count()

    heard = told(spark, tmp_path, work)
    assert heard[-1]["state"] == "failed" and "no room left" in heard[-1]["failure"] and [h["batches"] for h in heard][:2] == [0, 1]


@pytest.mark.parametrize("state", ["ended", "failed"])
def test_runs_that_are_over_leave_nothing(state):
    heard = []
    listener = st.StatusListener(heard.append)
    listener.tell("r", query="q")
    listener.tell("r", query="q")
    listener.tell("r", state=state)
    assert [h["state"] for h in heard] == ["running", state] and listener.told == {}
