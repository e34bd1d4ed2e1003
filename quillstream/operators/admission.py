"""Admission control in batch: sliding-window limits, and short-lived idempotent jobs, as folds over ordered events.

Events are shuffled by key, sorted within partitions, and streamed through one fold a task, which holds the state
of a single key: a limiter's accepted times of the last window, a job's few fields, a client's live jobs.  A key
with any number of events takes time in proportion to them.  Null keys are one key; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.cluster import ship

JOB_TTL_SECONDS = 600


def limiter_step(recent: list[int], us: int, span: int, limit: int) -> tuple[list[int], bool]:
    """State after a call at ``us``, and whether it passes."""
    if limit <= 0:
        return recent, True
    first = next((i for i, t in enumerate(recent) if us - t <= span), len(recent))  # times ascend
    recent = recent[first:]
    return (recent + [us], True) if len(recent) < limit else (recent, False)


def job_step(status: str | None, at: int, no: int, us: int, op: str, span: int) -> tuple[str | None, int, int, str]:
    """(status, updated at, number of jobs, outcome) after a call on a request id's job."""
    expired = status is not None and op in ("create", "get") and us - at > span
    live = None if expired else status
    if op == "create":
        return ("pending", us, no + 1, "created") if live is None else (live, at, no, "existing")
    if op == "get":
        return live, at, no, live or "none"
    if live is None:
        return None, at, no, "none"
    if op == "delete":
        return None, at, no, "done"
    return ("complete" if op == "finish" else "error"), us, no, "done"


def _fold(rows: DataFrame, new: Callable[[], Any], step: Callable[..., tuple], outputs: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Rows (key, id, us, …) with outputs of ``step(state, row…) -> (state, outputs)``, in order of (us, id) within a key."""
    ship(rows.sparkSession)
    names, extra = rows.columns, rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = run  # no key equals it
        state = None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = []
            for k, _, us, *rest in zip(*cols, strict=True):
                if key is run or k != key:
                    key, state = k, new()
                state, got = step(state, us, *rest)
                out.append(got)
            made = [pa.array([x[i] for x in out], t) for i, t in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *outputs])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("key").sortWithinPartitions("key", "us", "id", *extra).mapInArrow(run, f"{kinds}, {schema}")


def rate_limit(events: DataFrame, window_seconds: int, limit: int, key: str = "user_id", id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """(id, key, allowed): an event passes if fewer than ``limit`` passed events lie within the window before it.

    An accepted event leaves when it is more than the window old; rejected ones don't count.  limit <= 0: all pass.
    """
    rows = events.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    if limit <= 0:
        return rows.select("id", "key", F.lit(True).alias("allowed"))
    span = window_seconds * 1_000_000

    def step(recent: list[int], us: int) -> tuple:
        recent, ok = limiter_step(recent, us, span, limit)
        return recent, (ok,)

    return _fold(rows, list, step, {"allowed": pa.bool_()}, "allowed boolean").select("id", "key", "allowed")


def job_trace(events: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """(id, key, op, outcome, job_no) for events (key, id, us, op) with op in create, finish, fail, get, delete.

    A job expires when it was last updated more than the lifetime ago; that is noticed on create and get only,
    so finish and fail revive one that nobody looked at.  create on a live job returns it (``existing``).
    job_no counts the jobs made for a key; outcome is what the caller sees: created, existing, none, or a status.
    """
    span = ttl_seconds * 1_000_000

    def step(state: tuple, us: int, op: str) -> tuple:
        *state, outcome = job_step(*state, us, op, span)
        return state, (outcome, state[2])

    out = _fold(events.select("key", "id", "us", "op"), lambda: (None, 0, 0), step, {"outcome": pa.string(), "job_no": pa.int64()}, "outcome string, job_no long")
    return out.select("id", "key", "op", "outcome", "job_no")


def admitted_jobs(events: DataFrame, window_seconds: int, limit: int, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """(id, key, request, outcome) for creates (key: the client, id, us, request): created, existing or refused.

    The quota is checked inside create: a request whose job is alive gets it and takes none of the quota, a refused
    one stores nothing, and one without a request id is a job of its own.  Requests belong to one client.
    """
    span, life = window_seconds * 1_000_000, ttl_seconds * 1_000_000

    def step(state: tuple, us: int, request: str | None) -> tuple:
        recent, jobs = state
        while jobs and us - jobs[next(iter(jobs))] > life:  # in order of their making
            del jobs[next(iter(jobs))]
        if request is not None and request in jobs:
            return state, ("existing",)
        recent, ok = limiter_step(recent, us, span, limit)
        if ok and request is not None:
            jobs[request] = us
        return (recent, jobs), ("created" if ok else "refused",)

    out = _fold(events.select("key", "id", "us", F.col("request").cast("string").alias("request")), lambda: ([], {}), step, {"outcome": pa.string()}, "outcome string")
    return out.select("id", "key", "request", "outcome")
