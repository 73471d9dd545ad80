"""A store's version and trash, with failures put in; progress of streams from their source to job states."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators.lifecycle import META, TRASH, Store, StoreError
from pagemill.streaming import jobs, progress

ROWS = "task_id string, n int"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), 1)
    for table in ("segments", "tasks"):
        s.write(table, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], ROWS))
    return s


def held(store):
    return {t: sorted((r.task_id, r.n) for r in store.read(t, ROWS).collect()) for t in store.tables()}


def test_versions(spark, tmp_path):
    root, done = str(tmp_path / "s"), []
    assert Store(spark, root, 2).version() == 2
    with pytest.raises(StoreError, match="version is 2"):
        Store(spark, root, 1)
    with pytest.raises(StoreError, match="no step to version 4"):
        Store(spark, root, 4, steps={3: lambda *_: done.append(3)})
    assert done == []

    def fails(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Store(spark, root, 4, steps={3: lambda *_: done.append(3), 4: fails})
    again = Store(spark, root, 4, steps={3: fails, 4: lambda _, where: done.append(where)})
    assert again.version() == 4 and done == [3, root]
    again.files.write("four", META)
    with pytest.raises(StoreError, match="no version: 'four'"):
        Store(spark, root, 4)


def test_version_whose_rename_was_lost(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 3)
    s.files.move([META], [f"{META}.new"])
    assert Store(spark, str(tmp_path / "s"), 3).version() == 3


def test_trash_and_back(store):
    before = held(store)
    place = store.delete_task("a", dt.datetime(2024, 1, 2))
    assert held(store) == {"segments": [("b", 3)], "tasks": [("b", 3)]} and [p for p, n in store.trash() if n > 0] == [place]
    store.restore_task(place)
    assert held(store) == before and store.trash() == []
    store.delete_task("a", dt.datetime(2024, 1, 2))
    later = store.delete_task("b", dt.datetime(2024, 3, 2))
    assert store.empty_trash(dt.datetime(2024, 2, 1)) > 0 and [p for p, _ in store.trash()] == [later]


def test_a_failed_delete_leaves_all_rows(store, monkeypatch):
    before, move = held(store), store.files.move

    def fails(source, target):
        if source[0] == "tasks":
            raise StoreError("disk")
        move(source, target)

    monkeypatch.setattr(store.files, "move", fails)
    with pytest.raises(StoreError, match="disk"):
        store.delete_task("a")
    assert held(store) == before and store.trash() == []


def test_a_failed_restore_leaves_the_trash(store, monkeypatch):
    place, move = store.delete_task("a"), store.files.move

    def fails(source, target):
        if source[0] == TRASH and source[2] == "tasks":
            raise StoreError("disk")
        move(source, target)

    with monkeypatch.context() as m:
        m.setattr(store.files, "move", fails)
        with pytest.raises(StoreError, match="disk"):
            store.restore_task(place)
    assert held(store) == {"segments": [("b", 3)], "tasks": [("b", 3)]}
    store.restore_task(place)
    assert len(held(store)["tasks"]) == 3


def test_refused_deletes(store, spark):
    for task, why in (("c", "no task c"), ("../a", "no name of a task"), ("", "no name of a task")):
        with pytest.raises(StoreError, match=why):
            store.delete_task(task)
    place = store.delete_task("a")
    store.write("tasks", spark.createDataFrame([("a", 9)], ROWS))
    with pytest.raises(StoreError, match="holds task_id=a again"):
        store.restore_task(place)


def test_a_stream_tells_how_far_it_is(spark, tmp_path):
    """Four files, a file a batch; the job states are those of the events, and a second run goes on counting."""
    source, told = str(tmp_path / "in"), str(tmp_path / "events")
    put = lambda n: spark.range(n).selectExpr("id", "id % 5 = 0 as skipped").coalesce(1).write.mode("append").parquet(source)

    def run(counts):
        reporter = progress.Reporter(spark, told, {"count": 40}, counts)
        spark.streams.addListener(reporter)
        try:
            rows = spark.readStream.schema("id bigint, skipped boolean").option("maxFilesPerTrigger", 1).parquet(source)
            seen = progress.observed(rows, "count", ~F.col("skipped"))
            query = progress.observed(seen, "other").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
            until = time.time() + 30
            while time.time() < until and str(query.runId) not in ended(told):
                time.sleep(0.2)
        finally:
            spark.streams.removeListener(reporter)

    for n in (10, 20, 10):
        put(n)
    run({})
    first = {r.job_id: r for r in jobs.track_batch(spark.read.schema(progress.EVENTS).json(told)).collect()}
    assert set(first) == {"count"} and first["count"].current == 32 and first["count"].percent == 80.0
    put(10)
    run(progress.counted(spark, told))
    query = jobs.track(progress.events(spark, told)).writeStream.outputMode("update").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last = spark.sql("select * from told").collect()[-1]
    assert (last.job_id, last.current, last.total, last.state) == ("count", 40, 40, "completed")


def ended(folder):
    import glob

    return " ".join(glob.glob(f"{folder}/*-end.json"))
