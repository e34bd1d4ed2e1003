"""Streaming twins of the admission folds: per-key state in Structured Streaming.

State is bounded: a limiter keeps the accepted times of one window (``limit`` of them at most), a job store one job
per request id, and either is removed by a timer once the watermark has passed the window or the lifetime: then
all of it has expired, and a later call finds what it would have found.  (A job's number starts anew, and finish or
fail no longer revive it.)  Events of a micro-batch are applied in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.cluster import ship
from quillstream.operators.admission import JOB_TTL_SECONDS, job_step, limiter_step


def _expire(state: GroupState, last_us: int, span: int) -> None:
    """Wake up when the watermark has passed the last time by the span."""
    state.setTimeoutTimestamp(max(last_us + span, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("time", F.timestamp_micros("us")).withWatermark("time", delay)


def rate_limit_stream(events: DataFrame, window_seconds: int, limit: int, key: str = "user_id", id_col: str = "event_id", ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """(id, key, allowed) of a stream of calls, which come at most ``delay`` late."""
    span = window_seconds * 1_000_000
    ship(events.sparkSession)
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(parts)).sort_values(["us", "id"])
        out = []
        for us in calls["us"]:
            recent, ok = limiter_step(recent, int(us), span, limit)
            out.append(ok)
        state.update((recent,))
        _expire(state, int(calls["us"].iloc[-1]), span)
        yield pd.DataFrame({"id": calls["id"], "key": keys[0], "allowed": out})

    return _timed(rows, delay).groupBy("key").applyInPandasWithState(run, "id long, key long, allowed boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def job_stream(events: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(id, key, op, outcome, job_no) of a stream (key, id, us, op) of calls, which come at most ``delay`` late."""
    span = ttl_seconds * 1_000_000
    ship(events.sparkSession)

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at, no = state.get if state.exists else (None, 0, 0)
        calls = pd.concat(list(parts)).sort_values(["us", "id"])
        outcomes, numbers = [], []
        for us, op in zip(calls["us"], calls["op"], strict=True):
            status, at, no, outcome = job_step(status, int(at), int(no), int(us), op, span)
            outcomes.append(outcome)
            numbers.append(no)
        state.update((status, at, no))
        _expire(state, int(calls["us"].iloc[-1]), span)
        yield pd.DataFrame({"id": calls["id"], "key": keys[0], "op": calls["op"], "outcome": outcomes, "job_no": numbers})

    rows = _timed(events.select("key", "id", "us", "op"), delay)
    return rows.groupBy("key").applyInPandasWithState(run, "id long, key long, op string, outcome string, job_no long", "status string, at long, no long", "append", GroupStateTimeout.EventTimeTimeout)
