"""Top-k of many questions inside the tasks that scan the chunks: chunks are scored where they are read, and only
each task's k best rows of a question are shuffled.

Questions are collected and broadcast in blocks of a checked number; one job scores all questions of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.cluster import ship

#: Questions that are broadcast at once.
QUESTION_BLOCK = 16_384
#: Entries of a score matrix.
TILE = 1 << 21
#: Scores of rows that don't take part, and of rows whose score is null, which rank last.
NO_ROW, NULL_SCORE = -np.inf, -1.0


class Best:
    """The k best (score, id) of each question so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, NO_ROW)
        self.ids = [np.empty(0, dtype="U1")] * n
        self.scores = [np.empty(0)] * n

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of questions ``first``… (rows) with the chunks ``ids`` (columns)."""
        want = (scores > NO_ROW) & (scores >= self.floor[first : first + len(scores), None])
        for r in np.nonzero(want.any(axis=1))[0]:
            q, j = first + r, np.nonzero(want[r])[0]
            s, i = np.concatenate((self.scores[q], scores[r, j])), np.concatenate((self.ids[q], ids[j]))
            best = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[best], i[best]
            if len(best) == self.k:
                self.floor[q] = s[best[-1]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(q, chunk_id, score) of what is left, some thousand rows at a time."""
        for a in range(0, len(self.ids), 256):
            part = range(a, min(a + 256, len(self.ids)))
            q = np.repeat(np.arange(part.start, part.stop), [len(self.ids[x]) for x in part])
            s = np.concatenate([self.scores[x] for x in part])
            ids = [i for x in part for i in self.ids[x].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.string()), pa.array(s, mask=s == NULL_SCORE)], names=["q", "chunk_id", "score"])


def order(qid: str = "qid"):
    return Window.partitionBy(qid).orderBy(F.desc("score"), F.asc("chunk_id"))


def blocks_of(questions: DataFrame) -> Iterator[list[Any]]:
    """The rows of ``questions`` in lists of QUESTION_BLOCK at most (or little more)."""
    rows = questions.limit(QUESTION_BLOCK + 1).collect()
    if len(rows) <= QUESTION_BLOCK:
        yield rows
        return
    n = 2 * -(-questions.count() // QUESTION_BLOCK)
    for b in range(n):
        yield questions.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).collect()


def scan_topk(questions: DataFrame, chunks: DataFrame, k: int, prepare: Callable[[list[Any]], Any], score: Callable[[Any, pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best chunks of each question.

    ``prepare`` makes of a block of question rows what tasks need; ``score`` yields, of that and a batch of chunks
    (whose first column is chunk_id), matrices of scores from a first question on.
    """
    spark = questions.sparkSession
    ship(spark)
    out = None
    kind = questions.schema["qid"].dataType.simpleString()
    for rows in blocks_of(questions):
        if not rows:
            continue
        shared, n = spark.sparkContext.broadcast(prepare(rows)), len(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=n) -> Iterator[pa.RecordBatch]:
            best, step = Best(n, k), max(16, TILE // n)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    ids = np.array(batch.column(0).to_pylist())
                    for first, scores in score(shared.value, batch):
                        best.offer(first, scores, ids)
            yield from best.batches()

        names = spark.createDataFrame([(i, r.qid) for i, r in enumerate(rows)], f"q long, qid {kind}")
        found = chunks.mapInArrow(run, "q long, chunk_id string, score double").join(F.broadcast(names), "q").select("qid", "chunk_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"qid {kind}, chunk_id string, score double, rank long")
    return out.withColumn("rank", F.row_number().over(order()).cast("long")).filter(F.col("rank") <= k)
