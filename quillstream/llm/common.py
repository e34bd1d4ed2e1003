"""Plumbing that the operators share: shared storage, shipping the package, cutting Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.cluster import ship  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and
    all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> str:
    """The path in the shared folder that a table is written to."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


#: Shuffle partitions whose narrow rows go to one file.
NARROW = 8


def materialize(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and survives lost executors.

    ``narrow``: a few numbers a row, out of a shuffle; several partitions go to one file.
    """
    if narrow:
        df = df.coalesce(max(NARROW, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


#: Rows of a table of ids that may be broadcast.
FEW = 500_000


def few(table: DataFrame) -> DataFrame | None:
    """A written table of narrow rows, or None where it has more rows than may be broadcast."""
    return table if table.count() <= FEW else None


#: Keys that may be broadcast because so many rows have them.
MANY = 100_000


def met(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join with a written table of distinct keys, of which ``n`` says how many of the rows have them.

    A small table is broadcast.  Of a larger one the keys are that have a share of 1 / MANY of all rows, and so are
    MANY at most; the rows of the others are shuffled, none of which gathers more than that share.
    """
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), on)
    total = table.agg(F.sum(n)).first()[0]
    hot, cold = table.filter(F.col(n) * MANY >= total), table.filter(F.col(n) * MANY < total)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def lowest(rows: DataFrame, key: str, counts: dict, k: int) -> list[Row]:
    """Of each value of ``key`` (``counts``: how many rows each has) the ``k`` rows (id, …) of lowest hash of the id.

    Hashes are uniform, so a bound on them leaves little more than k rows of a key, before any is shuffled; should it
    leave fewer (as rows may repeat an id), all rows are ranked.
    """
    if not counts:
        return []
    h = F.xxhash64("id")

    def chosen(some: DataFrame) -> list[Row]:
        place = F.row_number().over(Window.partitionBy(key).orderBy(h, "id"))
        return some.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place").collect()

    bound = {x: min(2**63 - 1, -(2**63) + int(2**64 * (k + 8 * k**0.5 + 64) / n)) for x, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])[F.col(key)]
    got = chosen(rows.filter(h <= limit))
    have = Counter(r[key] for r in got)
    return got if all(have[x] >= min(k, n) for x, n in counts.items()) else chosen(rows)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of the given string column (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += (n or 0) + 64
    yield batch.slice(start)


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine: idle workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What this worker keeps from task to task: of an operator the function that lets go of it.
KEPT: dict[str, Callable[[], object]] = {}


def let_go(but: str = "") -> None:
    """Drop what other operators' tasks have kept in this worker."""
    gone = [KEPT.pop(x) for x in [*KEPT] if x != but]
    for drop in gone:
        drop()
    if gone:
        trim()


#: Bytes of the Arrow batches that workers are sent, unless the session has a setting: a task's texts are copied in
#: the JVM's buffers and again in the worker's.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def mapped(rows: DataFrame, run: Callable, schema: str | StructType, keeps: str = "") -> DataFrame:
    """``mapInArrow`` in small batches; tasks start without what other operators kept in the worker (``keeps``: this one),
    and give freed memory back."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        yield from run(batches)
        trim()

    return rows.mapInArrow(task, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as the empty one."""
    return [x if x is not None else "" for x in column.to_pylist()]
