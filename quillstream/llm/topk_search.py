"""Exact top-k search by distributed histogram selection.

Queries are handled in blocks of a fixed number of vectors, the only thing that is broadcast; the hits of a block
are written before the next one, so the last plan is one scan, however many blocks there were.  For a block
every candidate is scored (one matrix product per Arrow batch); each task keeps a histogram of its scores and
reports, per query, only the bins that hold its own k best, as nothing below them can decide the k-th value.
The summed histogram tells the bin of each query's k-th value; the next pass refines that bin, until bins are
one integer wide and the k-th value is known.  A last pass keeps scores at or above it; of those a task
reports its k best by (score, id), so ties never gather, and one small ranking per query ends the work.

Defined results: null ids, null vectors and vectors with null or non-finite components take no part; rows that
repeat an id all are candidates of other ids, and of a repeated query the best of all its rows count; vectors are
compared with vectors of equal length only; components from 2**43 on, and sums of squares from 2**62 on, are refused
with ValueError, since products must fit in 64 bits; empty tables give empty results; a query with fewer than k
candidates returns all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import materialize, ship, written

QUERY_BLOCK = 8192
#: Entries of a task's histograms: a block of few queries has finer bins, of many queries coarser ones and more passes.
CELLS = 1 << 21
#: Bounds of a whole component, where doubles are exact, and of a sum of squares, which bounds every product.
MOST_COMPONENT, MOST_SQUARES = 2.0**51, 2.0**62
MOST_BINS = 4096
#: Entries of a score matrix.
SCORES = 1 << 20
HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, q (array<double> of floor(256 x)), dim; invalid vectors left out."""
    ok = F.forall(
        F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)
        .select("id", F.transform("v", lambda x: F.floor(F.lit(256.0) * x).cast("double")).alias("q"))
        .withColumn("dim", F.size("q"))
    )


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where those are exact."""
    most = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if most * most * max(queries.shape[1], 1) < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _histograms(ids, q, lo, width, k, dim, bins):
    """Map function: (query, bin, n) for the highest bins that hold a task's k best."""

    def run(batches):
        hist, chunk = np.zeros((len(ids), bins + 1), dtype=np.int64), max(16, SCORES // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                own = part.column(0).to_numpy()
                s = _scores(q, _matrix(part.column(1), dim))
                b = np.minimum((s - lo[:, None]) // width[:, None], bins)
                use = (b >= 0) & (own[None, :] != ids[:, None])
                flat = (b + np.arange(len(ids))[:, None] * (bins + 1))[use]
                hist += np.bincount(flat, minlength=hist.size).reshape(hist.shape)
        above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
        i, j = np.nonzero((hist > 0) & (above < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(hist[i, j], pa.int64())], names=["qi", "bin", "n"]
        )

    return run


def _best(ids, q, least, k, dim):
    """Map function: each query's k best rows of a task, of those that score at least its bound."""

    def run(batches):
        found, chunk = [np.empty((0, 2), dtype=np.int64) for _ in ids], max(16, SCORES // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                own = part.column(0).to_numpy()
                s = _scores(q, _matrix(part.column(1), dim))
                use = (s >= least[:, None]) & (own[None, :] != ids[:, None])
                for i in np.nonzero(use.any(axis=1))[0]:
                    j = np.nonzero(use[i])[0]
                    both = np.concatenate([found[i], np.stack([s[i, j], own[j]], axis=1)])
                    found[i] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        n = [len(x) for x in found]
        all_rows = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n), pa.int64()), pa.array(all_rows[:, 1], pa.int64()), pa.array(all_rows[:, 0], pa.int64())],
            names=["query_id", "vec_id", "score"],
        )

    return run


def _kth(counts: DataFrame, k: int) -> dict[int, tuple[int, int]]:
    """query -> (bin of its k-th value, rows in higher bins), for queries with k candidates at least."""
    w = Window.partitionBy("qi").orderBy(F.desc("bin"))
    rows = (
        counts.groupBy("qi", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w))
        .filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("qi", "bin")
        .collect()
    )
    return {r.qi: r.bin for r in rows}


def topk_search(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every row for which ``is_query(id)`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    table = materialize(quantized(vectors, id_col, vec_col), "vectors")
    asked = table.filter(is_query(F.col("id")))
    shape = asked.groupBy("dim").count().collect()
    sizes = table.groupBy("dim").agg(
        F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max(F.array_max(F.transform("q", F.abs))).alias("large"))
    norms = {}
    for r in sizes.collect():
        if r.dim > 0 and (r.large >= MOST_COMPONENT or r.most >= MOST_SQUARES):
            raise ValueError("components are too large for exact 64-bit products")
        norms[r.dim] = r.most
    paths = []
    for dim, n in ((r["dim"], r["count"]) for r in shape):
        n_blocks = -(-n // block)
        rows = table.filter(F.col("dim") == dim).select("id", "q")
        for b in range(n_blocks):
            mine = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)).select("id", "q")
            got = sorted(mine.collect())
            if not got:
                continue
            ids = np.array([r.id for r in got], dtype=np.int64)
            q = np.array([r.q for r in got], dtype=np.float64).reshape(len(got), dim)
            bound = np.sqrt((q * q).sum(axis=1) * norms[dim]) + 1
            lo = -np.ceil(bound).astype(np.int64)
            bins = max(min(CELLS // len(ids), MOST_BINS), 2)
            width = np.maximum(1, -(-(2 * -lo + 2) // bins))
            kth: dict[int, int] = {}
            while True:
                run = _histograms(ids, q, lo, width, k, dim, bins)
                kth = _kth(rows.mapInArrow(run, "qi int, bin int, n long"), k)
                step = np.array([kth.get(i, 0) for i in range(len(ids))])
                # the last bin holds what lies beyond the refined range; the k-th value is never there once inside
                lo = lo + step * width
                if width.max() == 1:
                    break
                width = np.maximum(1, -(-width // bins))
            least = np.array([lo[i] if i in kth else np.iinfo(np.int64).min for i in range(len(ids))])
            paths.append(written(rows.mapInArrow(_best(ids, q, least, k, dim), HITS), "hits"))
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = spark.read.schema(HITS).parquet(*paths)  # one scan, however many blocks there were
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(embeddings: DataFrame) -> DataFrame:
    return topk_search(embeddings, lambda c: F.pmod(c, F.lit(50)) == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
