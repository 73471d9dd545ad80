"""Progress of jobs: a state for each job, as a stream and as a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id string, current bigint, total bigint, state string, percent double, remaining double"
STATE = "started double, last double, current long, total long, remaining double, state string"
RETENTION_HOURS = 24


def smoothed(previous: float | None, since: float, elapsed: float, current: int, total: int) -> float:
    """Seconds left: the time for a step so far, for the steps that are left and some more for the end; .35 of that and
    .65 of the previous estimate, which has become shorter by the time since. The constants are fixed values."""
    left = max(0, total - current) + min(10.0, max(1.0, 0.03 * total))
    raw = max(elapsed, 0.001) / current * left
    return raw if previous is None else 0.65 * max(0.0, previous - since) + 0.35 * raw


def advance(state: tuple | None, ts: float, current: int, total: int, said: str) -> tuple:
    """The state after one event; a new total or a step back starts anew."""
    if state is None or state[3] != total or current < state[2]:
        state = (ts, ts, 0, total, -1.0, said)
    started, last, _, _, remaining, _ = state
    left = smoothed(None if remaining < 0 else remaining, ts - last, ts - started, current, total) if current > 0 and total > 0 else remaining
    return started, ts, current, total, left, "completed" if current >= total and said != "failed" else said


def _row(job: str, s: tuple) -> dict:
    return {"job_id": job, "current": s[2], "total": s[3], "state": s[5], "percent": round(100.0 * s[2] / max(1, s[3]), 1), "remaining": round(max(0.0, s[4]), 3)}


def track(events: DataFrame) -> DataFrame:
    """A stream of (job_id, ts, current, total, state) as one of job states; a job is kept for a day of
    event time after its last event."""

    def update(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        own = tuple(state.get) if state.exists else None
        for frame in frames:
            for r in frame.sort_values(["ts", "current"]).itertuples():
                own = advance(own, r.ts.timestamp(), int(r.current), int(r.total), r.state)
        state.update(own)
        state.setTimeoutTimestamp(max(int(own[1] * 1000) + RETENTION_HOURS * 3600 * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([_row(key[0], own)])

    return events.withWatermark("ts", "1 hour").groupBy("job_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def track_batch(events: DataFrame) -> DataFrame:
    """The same states from a table of events, a job at a time in order."""

    def fold(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = None
        for r in frame.sort_values(["ts", "current"]).itertuples():
            own = advance(own, r.ts.timestamp(), int(r.current), int(r.total), r.state)
        return pd.DataFrame([_row(key[0], own)])

    return events.groupBy("job_id").applyInPandas(fold, OUT)


def once_active(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """A stream without repeated submissions of one (kind, key) within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["kind", "job_key"])


def progress(events: DataFrame) -> DataFrame:
    """(job_id, event_id, current, total, percent): the running count of each job's events."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    total = events.groupBy("job_id").agg(F.count("*").alias("total"))
    return events.join(total, "job_id").withColumn("current", F.row_number().over(w).cast("bigint")).select("job_id", "event_id", "current", "total", F.round(100.0 * F.col("current") / F.col("total"), 1).alias("percent"))


def retained(events: DataFrame, hours: int = RETENTION_HOURS) -> DataFrame:
    """(job_id, last_ts, n): jobs whose last event lies within `hours` of the last event of all."""
    jobs = events.groupBy("job_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    newest = events.agg(F.max("ts").alias("newest"))
    return jobs.join(F.broadcast(newest)).where(F.col("last_ts") >= F.col("newest") - F.expr(f"interval {hours} hours")).drop("newest")  # one row
