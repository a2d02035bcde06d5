"""Stateful operators: rate limits, job states, event windows. Batch and stream share the transition code.

``allowed`` keeps, per key, the times of the accepted events within the window; a refused event takes no room. In a stream the state is one short list per key,
dropped by a timer; in batch the events of a key are folded in order of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Requests within seconds; order of a job's states.
LIMIT, SECONDS = 30, 60
STATES = ("queued", "running", "completed", "partial", "failed")
_ACCEPTED = "user_id bigint, event_id bigint, ts timestamp, accepted boolean"


def decide(times: deque, now: float, limit: int, seconds: float) -> bool:
    """Whether an event is accepted; times of accepted ones are kept up to date."""
    while times and times[0] <= now - seconds:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def allowed(events: DataFrame, limit: int = LIMIT, seconds: float = SECONDS, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, accepted) of every event; ties by event_id. Events without key or time are left out.

    The fold needs a key's events in order, so a key's events meet in one task, as batches of Arrow rows sorted by Spark on disk, never as one frame: ``mapInPandas``
    over rows partitioned and sorted by key holds one batch and one list of at most ``limit`` times.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("bigint").alias("user_id"), F.col("event_id").cast("bigint"), F.col("ts").cast("timestamp"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times = None, deque()
        for f in frames:
            said = []
            for k, t in zip(f["user_id"], f["ts"].astype("int64") if str(f["ts"].dtype).endswith("[ns]") else f["ts"].astype("datetime64[ns]").astype("int64")):
                if k != who:
                    who, times = k, deque()
                said.append(decide(times, t / 1e9, limit, seconds))
            yield f.assign(accepted=said)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, _ACCEPTED)


def allowed_stream(events: DataFrame, limit: int = LIMIT, seconds: float = SECONDS, late: str = "1 hour") -> DataFrame:
    """The same over a stream of (user_id, event_id, ts), in order of time within each micro-batch; events later than the watermark are dropped by Spark.

    A key's state goes when the watermark has passed its window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        said = [decide(times, t.timestamp(), limit, seconds) for t in batch["ts"]]
        state.update((list(times),))
        end = int((batch["ts"].max().timestamp() + seconds) * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "ts": batch["ts"], "accepted": said})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, _ACCEPTED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_states(jobs: DataFrame, keys: list[str], state: str, time: str) -> DataFrame:
    """The last state of each key by time; of equal times the later state in the order of a job's life."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col(state)), F.lit(0))
    return jobs.groupBy(*keys).agg(F.max_by(state, F.struct(time, rank)).alias("state"))


def in_windows(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by event type in windows of event time; works on tables and on streams, where ``late`` sets the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    e = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), "events")
