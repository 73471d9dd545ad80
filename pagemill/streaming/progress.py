"""How far a stream has come, told by the stream itself: counts observed in its plan become events of jobs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "job_id string, ts timestamp, current bigint, total bigint, state string"


def observed(rows: DataFrame, job: str, done=None) -> DataFrame:
    """rows, of which each micro-batch tells how many there are (of those where `done` holds). The count is an accumulator of
    the tasks that run anyway: no further pass, no shuffle. `job` is the name of the observation."""
    return rows.observe(f"job:{job}", F.count(F.lit(1) if done is None else F.when(done, F.lit(1))).alias("rows"))


class Reporter(StreamingQueryListener):
    """Writes an event (EVENTS) of a job's progress for each micro-batch of its observed query, and one for its end.

    `totals` names the rows that each job expects; jobs that are not in it are not reported. Events are small JSON files,
    one an event, in a folder that `jobs.track` reads as a stream, renamed into place once they are whole. Counts go on
    from `counts`, those that `counted` finds in the folder, if a query starts again; a batch that is told twice, as after
    a lost driver, counts once, as its number is part of its file's name.
    """

    def __init__(self, spark: SparkSession, folder: str, totals: dict[str, int], counts: dict[str, int] | None = None):
        self.totals, self.counts, self.folder = totals, dict(counts or {}), folder.rstrip("/")
        self.runs: dict[str, set[str]] = {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.folder))

    def _tell(self, job: str, ts: str, name: str, state: str) -> None:
        event = {"job_id": job, "ts": ts, "current": self.counts.get(job, 0), "total": self.totals[job], "state": state}
        hidden, path = self._path(f"{self.folder}/_{job}-{name}"), self._path(f"{self.folder}/{job}-{name}.json")
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray((json.dumps(event) + "\n").encode()))
        finally:
            stream.close()
        self.fs.rename(hidden, path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            job = name.removeprefix("job:")
            if name == job or job not in self.totals:
                continue
            self.runs.setdefault(str(p.runId), set()).add(job)
            told = f"{p.id}-{p.batchId:09d}"
            if row["rows"] and not self.fs.exists(self._path(f"{self.folder}/{job}-{told}.json")):
                self.counts[job] = self.counts.get(job, 0) + row["rows"]
                self._tell(job, p.timestamp, told, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        now = dt.datetime.now(dt.UTC).isoformat()
        for job in sorted(self.runs.pop(str(event.runId), ())):
            self._tell(job, now, f"{event.runId}-end", "failed" if event.exception else "stopped")


def counted(spark: SparkSession, folder: str) -> dict[str, int]:
    """How many rows each job has told of in a folder of events: a row a job."""
    return {r.job_id: r.n for r in spark.read.schema(EVENTS).json(folder).groupBy("job_id").agg(F.max("current").alias("n")).collect()}


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder as a stream, for `jobs.track`."""
    return spark.readStream.schema(EVENTS).json(folder)
