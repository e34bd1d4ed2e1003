"""Sparse channel: BM25 top-k of many questions, scored in the tasks that scan the chunks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.cluster import ship
from quillstream.functions.text import analyze
from quillstream.operators.scan import NO_ROW, scan_topk

K1, B = 1.2, 0.75


def hashed_terms(c: Column) -> Column:
    """Tokens of the analysis as 64-bit hashes; null for a null text."""
    return F.transform(analyze(c), lambda w: F.xxhash64(w))


def _terms(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (id, hashes): how many tokens each has (-1: null), and distinct (row, wanted term, times)."""
    column = batch.column(1)
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(wanted) or not len(flat):
        return size, *(np.empty(0, dtype=np.int64) for _ in range(3))
    at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
    hit = np.nonzero(wanted[at] == flat)[0]
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))[hit]
    key, tf = np.unique(row * len(wanted) + at[hit], return_counts=True)
    return size, key // len(wanted), key % len(wanted), tf


def _statistics(hashed: DataFrame, wanted: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Number of chunks, their mean length, and how many have each wanted term: one pass of the corpus."""
    spark = hashed.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        n, known, total, df = 0, 0, 0, np.zeros(len(terms), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                size, _, term, _ = _terms(whole.slice(at, 1024), terms)
                n, known, total = n + len(size), known + int((size >= 0).sum()), total + int(size[size >= 0].sum())
                df += np.bincount(term, minlength=len(terms))
        used = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2, -3], used)), pa.int64()), pa.array(np.concatenate(([n, known, total], df[used])), pa.int64())], names=["at", "n"])

    got = {r["at"]: r["n"] for r in hashed.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    df = np.array([got.get(i, 0) for i in range(len(wanted))], dtype=np.int64)
    return got.get(-1, 0), got.get(-3, 0) / max(got.get(-2, 0), 1), df


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int, col: str = "index_text", question_col: str = "question") -> DataFrame:
    """(qid, chunk_id, score, rank): k best chunks per question, any term may match, ties to the smaller id.

    One pass counts the terms that a block of questions asks for, a second scores every chunk in its scan task; no
    posting leaves a task.  A null text counts as a chunk without a length; a chunk without a term is no hit.
    """
    hashed = chunks.select("chunk_id", hashed_terms(F.col(col)).alias("terms"))

    def prepare(rows: list[Any]) -> tuple:
        asked = [np.unique(np.array(r.terms or [], dtype=np.int64), return_counts=True) for r in rows]
        q = np.repeat(np.arange(len(rows)), [len(t) for t, _ in asked])
        term, qtf = (np.concatenate([a[i] for a in asked]) for i in (0, 1))
        wanted, at = np.unique(term, return_inverse=True)
        n, mean, df = _statistics(hashed, wanted)
        weight = qtf * np.log(1 + (n - df[at] + 0.5) / (df[at] + 0.5))
        by_term = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(wanted))
        return len(rows), wanted, mean, q[by_term], weight[by_term], count, np.cumsum(count) - count

    def score(shared: Any, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        n, wanted, mean, q, weight, count, start = shared
        size, row, term, tf = _terms(batch, wanted)
        part = tf / (tf + K1 * (1 - B + B * size[row] / (mean or 1)))
        many = count[term]
        at = np.repeat(start[term] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        sums = np.bincount(q[at] * len(size) + np.repeat(row, many), weight[at] * np.repeat(part, many), n * len(size)).reshape(n, len(size))
        yield 0, np.where(sums > 0, np.round(sums, 9), NO_ROW)

    return scan_topk(questions.select("qid", hashed_terms(F.col(question_col)).alias("terms")), hashed, k, prepare, score)
