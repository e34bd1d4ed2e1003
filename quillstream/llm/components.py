"""Connected components: of few edges in one task, of many by alternating large-star and small-star steps over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import mapped, materialize, ship

#: Edges that one task takes (16 bytes each).
ONE_TASK = 1_000_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and for each the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b):  # a component's root goes to the least neighbour of its members
            np.minimum.at(label, before[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: (node, component) of all edges (u, v)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, component = labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(component[i : i + 100_000])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); a component is its smallest node.

    Up to ONE_TASK edges are counted and then given to one task.  Beyond, steps go on until nothing changes: neighbourhood minima are partial aggregates and meet the edges in a join, so a node with a third of all
    edges is never gathered.  Each step is written to the shared folder.
    """
    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", True
    )
    before = _state(e)
    if before[0] <= ONE_TASK:
        ship(edges.sparkSession)
        return materialize(e.repartition(1).transform(mapped, _in_one_task, "node long, component long"), "components")
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the smallest in reach
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large", True)
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "small", True)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
