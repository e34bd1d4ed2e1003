"""Questions to answers with injected models: embedding, image analysis and answer are mappers over DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import AnswerConfig, missing_settings
from quillstream.operators import evidence, service
from quillstream.sources import corpus

#: (qid, dense_query) to (qid, embedding).
Embedder = Callable[[DataFrame], DataFrame]
#: (qid, question, images) to (qid, status, semantic_query, keywords).
ImageAnalyst = Callable[[DataFrame], DataFrame]


class Retriever(Protocol):
    """Anything that finds rows for questions."""

    def retrieve(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of (qid, dense_query, sparse_query, …): candidate rows (qid, pos, chunk_id, …) and metrics (qid, result_count, threshold_filtered_all)."""
        ...


class Generator(Protocol):
    """Anything that answers from evidence items: ``evidence.answer`` with a model is one."""

    def __call__(self, items: DataFrame) -> DataFrame: ...


class MissingInput(RuntimeError):
    """A table or a setting that is needed isn't there."""


def probe(
    spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("documents", "labels", "embeddings", "benchmark"),
    settings: tuple[str, ...] = (), values: Mapping[str, str] = os.environ,
) -> dict[str, int]:
    """Looks for the settings and reads one row of each table; raises MissingInput with the names of what isn't there."""
    found, missing = {}, [f"{n}: not set" for n in missing_settings(list(settings), dict(values))]
    for name in tables:
        try:
            found[name] = len(corpus.table(spark, sf_dir, name).limit(1).collect())
        except Exception as e:  # noqa: BLE001  whatever store it is
            missing.append(f"{name}: {type(e).__name__}")
    if missing:
        raise MissingInput(", ".join(missing))
    return found


def image_queries(requests: DataFrame, analyst: ImageAnalyst) -> DataFrame:
    """(qid, semantic_query, keyword_query, error) of requests (qid, question, images).

    Requests without images never reach the analyst: both queries are the question.  An analysis whose status is not
    ``completed``, or without a query or keywords, is an error.
    """
    question = service.strip(F.coalesce("question", F.lit("")))
    has = F.coalesce(F.size("images"), F.lit(0)) > 0
    plain = requests.filter(~has).select("qid", question.alias("semantic_query"), question.alias("keyword_query"), F.lit(None).cast("string").alias("error"))
    q = service.image_query(F.col("semantic_query"), F.col("keywords"))
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    error = F.when(~done, "image search analysis did not complete").when(F.coalesce(q["invalid"], F.lit(True)), "image search analysis returned an empty query")
    looked = analyst(requests.filter(has).select("qid", "question", "images")).select("qid", q["semantic_query"].alias("semantic_query"), q["keyword_query"].alias("keyword_query"), error.alias("error"))
    return plain.unionByName(looked)


class AnswerPipeline:
    """Rejects empty retrievals; otherwise the grounded answer.

    Searches use the queries that images gave; the answer is asked the question as it was put.
    """

    def __init__(self, retriever: Retriever, generator: Generator, analyst: ImageAnalyst | None = None, config: AnswerConfig | None = None):
        self.retriever, self.generator, self.analyst, self.config = retriever, generator, analyst, config or AnswerConfig()

    def ask(self, requests: DataFrame) -> DataFrame:
        """(qid, status, reason, conclusion, reasoning, evidence, error) of requests (qid, question, images, …)."""
        if self.analyst is None:
            asked = requests.withColumn("semantic_query", F.lit("")).withColumn("keyword_query", F.lit("")).withColumn("query_error", F.lit(None).cast("string"))
        else:
            asked = requests.join(image_queries(requests, self.analyst).withColumnRenamed("error", "query_error"), "qid")
        q = service.query_fallback(F.col("question"), F.col("semantic_query"), F.col("keyword_query"))
        ready = asked.select("*", q["dense_query"].alias("dense_query"), q["sparse_query"].alias("sparse_query"), q["invalid"].alias("invalid"))
        ready = ready.withColumn("error", F.coalesce("query_error", F.when(F.col("invalid"), F.lit("question must not be empty"))))
        rows, metrics = self.retriever.retrieve(ready.filter("error is null").drop("error", "invalid", "query_error"))
        items = evidence.catalog(evidence.candidates(rows, self.config), self.config)
        answers = self.generator(items).withColumnRenamed("error", "answer_error").withColumnRenamed("conclusion", "given").withColumnRenamed("reasoning", "steps")
        gate = service.gate(F.coalesce("result_count", F.lit(0)), F.col("threshold_filtered_all"))
        out = ready.select("qid", "error").join(metrics, "qid", "left").join(answers, "qid", "left")
        failed = F.col("error").isNotNull()
        return out.select(
            "qid", F.when(~failed, gate["status"]).alias("status"), F.when(~failed, gate["reason"]).alias("reason"),
            F.when(~failed, F.coalesce(gate["conclusion"], F.col("given"))).alias("conclusion"),
            F.when(~failed, F.coalesce(F.when(gate["reasoning"].isNotNull(), F.array(gate["reasoning"])), F.col("steps"))).alias("reasoning"),
            "evidence", F.coalesce("error", "answer_error").alias("error"),
        )
