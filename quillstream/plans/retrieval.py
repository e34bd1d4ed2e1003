"""The retrieval plan over the driver's tables, stage by stage and lazy; each stage is a DataFrame keyed by qid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import SHIPPED_ANSWER, SHIPPED_HYBRID, SHIPPED_RETRIEVAL, AnswerConfig, HybridConfig, RetrievalConfig
from quillstream.operators import channels, dense, evidence, siblings, sparse
from quillstream.sources import corpus

#: Shipped settings with a keyword floor that suits short Latin texts, and an evidence budget that binds.
HYBRID = replace(SHIPPED_HYBRID, sparse_min_score=8.0)
RETRIEVAL = SHIPPED_RETRIEVAL
ANSWER = replace(SHIPPED_ANSWER, max_candidates=12, max_candidate_chars=700, max_context_chars=5000)


class Retrieval:
    """Dense and sparse hits, floors, fusion, seeds, siblings, results, metrics and evidence of all questions.

    ``embed`` maps (qid, question) to (qid, embedding); without it questions have the vectors that are stored for them.
    """

    def __init__(
        self, spark: SparkSession, sf_dir: str, hybrid: HybridConfig = HYBRID, retrieval: RetrievalConfig = RETRIEVAL, answer: AnswerConfig = ANSWER,
        embed: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.dir, self.hybrid, self.retrieval, self.config, self.embed = spark, sf_dir, hybrid, retrieval, answer, embed

    @cached_property
    def chunks(self) -> DataFrame:
        return corpus.chunks(self.spark, self.dir)

    @cached_property
    def questions(self) -> DataFrame:
        asked = corpus.questions(self.spark, self.dir)
        return asked if self.embed is None else asked.drop("embedding").join(self.embed(asked.select("qid", "question")).select("qid", "embedding"), "qid", "left")

    @cached_property
    def filters(self) -> DataFrame:
        return self.questions.select("qid", "want_standard", "want_zone")

    @cached_property
    def dense_raw(self) -> DataFrame:
        asked = self.questions.filter("embedding is not null")
        return dense.dense_topk(asked, corpus.vectors(self.spark, self.dir), self.hybrid.dense_top_k)

    @cached_property
    def sparse_raw(self) -> DataFrame:
        return sparse.bm25_topk(self.questions, self.chunks, self.hybrid.sparse_top_k)

    @cached_property
    def dense(self) -> DataFrame:
        return channels.post_filter(self.dense_raw, self.chunks)

    @cached_property
    def sparse(self) -> DataFrame:
        return channels.post_filter(self.sparse_raw, self.chunks)

    @cached_property
    def dense_above(self) -> DataFrame:
        return channels.above(self.dense, self.hybrid.dense_min_score)

    @cached_property
    def sparse_above(self) -> DataFrame:
        return channels.above(self.sparse, self.hybrid.sparse_min_score)

    @cached_property
    def fused(self) -> DataFrame:
        return channels.fuse(self.dense_above, self.sparse_above, self.hybrid)

    @cached_property
    def top(self) -> DataFrame:
        """Fused rows within the search's own limit and the request's."""
        limits = self.questions.select("qid", "top_k")
        cut = channels.top_fused(self.fused, self.hybrid.seed_top_k).join(limits, "qid")
        wanted = F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(F.lit(self.retrieval.top_k))
        return cut.filter(F.col("pos") <= F.least(F.lit(self.hybrid.seed_top_k), wanted)).drop("top_k")

    @cached_property
    def seeds(self) -> DataFrame:
        return siblings.seeds(self.top)

    @cached_property
    def siblings(self) -> DataFrame:
        return siblings.siblings(self.seeds, corpus.derived_from(self.spark, self.dir), self.chunks, self.retrieval.max_siblings)

    @cached_property
    def results(self) -> DataFrame:
        return siblings.interleave(self.seeds, self.siblings)

    @cached_property
    def metrics(self) -> DataFrame:
        raw = self.dense.select("qid", "chunk_id").unionByName(self.sparse.select("qid", "chunk_id"))
        return siblings.metrics(self.questions, raw, self.top, self.results)

    @cached_property
    def candidates(self) -> DataFrame:
        payload = ["chunk_id", "text", "contextualized_text", "citation_label", "standard_id", "pdf_page_start", "pdf_page_end"]
        return evidence.candidates(self.results.join(self.chunks.select(*payload), "chunk_id"), self.config)

    @cached_property
    def items(self) -> DataFrame:
        return evidence.catalog(self.candidates, self.config)
