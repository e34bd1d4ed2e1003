"""Dense channel: exact cosine top-k of many questions, and an approximate variant with measured recall."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.scan import NULL_SCORE, order, scan_topk


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Vectors as doubles with their norm, computed once per row."""
    v = df.withColumn(col, F.col(col).cast("array<double>"))
    return v.withColumn("norm", F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x)))


def unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dim`` numbers and a length, and these as unit rows."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.nonzero(sizes == dim)[0]
    v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    norm = np.sqrt((v * v).sum(axis=1))
    ok = norm > 0  # false for nulls inside as well
    return at[ok], v[ok] / norm[ok, None]


def dense_topk(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): k best chunks per question by (1 + cosine) / 2, ties to the smaller id.

    The score is null where a norm is zero, a number is missing or lengths differ; such rows rank last.
    """

    def prepare(rows: list[Any]) -> tuple[int, np.ndarray, np.ndarray]:
        dim = max((len(r.embedding or ()) for r in rows), default=0)
        at, unit = unit_rows(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), dim)
        return len(rows), at, unit

    def score(shared: Any, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        n, asked, unit = shared
        at, rows = unit_rows(batch.column(1), unit.shape[1])
        out = np.full((n, batch.num_rows), NULL_SCORE)
        out[np.ix_(asked, at)] = np.round((1 + unit @ rows.T) / 2, 9)
        yield 0, out

    q = questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    v = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return scan_topk(q, v, k, prepare, score)


def dense_lsh(questions: DataFrame, vectors: DataFrame, k: int, bits: int = 6, tables: int = 36) -> DataFrame:
    """Approximate (qid, chunk_id, score, rank): candidates share a sign pattern of random hyperplanes in some table.

    A question also probes, in each table, the pattern with the sign of its nearest hyperplane changed.
    """
    import json
    import random

    dim = len(vectors.select("embedding").first().embedding)
    rng = random.Random(11)
    planes = [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]

    literal = F.from_json(F.lit(json.dumps(planes)), "array<array<array<double>>>")  # one literal in the plan

    def keys(col: str, probe: bool) -> Column:
        sides = F.transform(literal, lambda table: F.transform(table, lambda plane: dot(F.col(col), plane)))

        def patterns(side: Column, t: Column) -> Column:
            code = F.lit(0)
            for i in range(bits):
                code = code + F.when(side[i] > 0, 1 << i).otherwise(0)
            near = F.transform(side, F.abs)
            bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(bits)]), F.array_position(near, F.array_min(near)).cast("int"))
            codes = [code, code.bitwiseXOR(bit)] if probe else [code]
            return F.array(*[F.struct(t.alias("t"), c.alias("code")) for c in codes])

        return F.explode(F.flatten(F.transform(sides, patterns)))

    v = with_norm(vectors.select("chunk_id", "embedding"))
    q = with_norm(questions.select("qid", "embedding")).withColumnRenamed("embedding", "qv").withColumnRenamed("norm", "qn")
    found = q.select("qid", keys("qv", True).alias("key")).join(v.select("chunk_id", keys("embedding", False).alias("key")), "key").select("qid", "chunk_id").distinct()
    cosine = F.try_divide(dot(F.col("qv"), F.col("embedding")), F.col("qn") * F.col("norm"))
    scored = found.join(v, "chunk_id").join(q, "qid").select("qid", "chunk_id", F.round((1 + cosine) / 2, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order()).cast("long")).filter(F.col("rank") <= k)
