"""Filters behind an index scan, score floors, and weighted reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.config import HybridConfig
from quillstream.operators.scan import order


def eligible() -> Column:
    """Searchable and not inactive; null means neither."""
    return F.coalesce("searchable", F.lit(False)) & ~F.coalesce("inactive", F.lit(False))


def matches(parameter: str, column: str) -> Column:
    """A parameter that is null matches all; a null column matches no parameter."""
    return F.col(parameter).isNull() | (F.col(parameter) == F.col(column))


def post_filter(hits: DataFrame, chunks: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """Hits that pass the predicates, which apply after the index's top-k; ranks are positions among the rest.

    ``filters`` has (qid, want_standard, want_zone).
    """
    rows = hits.drop("rank").join(chunks.select("chunk_id", "standard_id", "zone", "searchable", "inactive"), "chunk_id").filter(eligible())
    if filters is not None:
        rows = rows.join(filters, "qid").filter(matches("want_standard", "standard_id") & matches("want_zone", "zone"))
    return rows.select("qid", "chunk_id", "score", F.row_number().over(order()).cast("long").alias("rank"))


def passes(score: Column, floor: float | None) -> Column:
    """At or above the floor; NaN is below any floor."""
    return F.lit(True) if floor is None else F.coalesce(~F.isnan(score) & (score >= floor), F.lit(False))


def above(hits: DataFrame, floor: float | None) -> DataFrame:
    """Rows at or above a score floor, ranked anew."""
    kept = hits.filter(passes(F.col("score"), floor)).drop("rank")
    return kept.withColumn("rank", F.row_number().over(order()).cast("long"))


def fuse(dense: DataFrame, sparse: DataFrame, config: HybridConfig, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per (qid, chunk_id): ranks and scores by channel, rrf_score, channels, and the payload columns.

    Within a channel the first of repeated ids counts, at its own rank.  The payload is the whole row of the
    first channel that has the id, also where its columns are null.
    """

    def tagged(rows: DataFrame, name: str, at: int) -> DataFrame:
        return rows.select("qid", "chunk_id", "rank", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel"), F.lit(at).alias("at"), F.struct(*payload, F.lit(at)).alias("payload"))

    both = tagged(dense, "dense", 0).unionByName(tagged(sparse, "sparse", 1))

    def of(channel: str, value: str) -> Column:
        first = F.min(F.when(F.col("channel") == channel, F.struct("rank", "score")))
        return first[value]

    out = both.groupBy("qid", "chunk_id").agg(
        of("dense", "rank").alias("dense_rank"), of("dense", "score").alias("dense_score"),
        of("sparse", "rank").alias("sparse_rank"), of("sparse", "score").alias("sparse_score"),
        F.array_sort(F.collect_set("channel")).alias("source_channels"),
        F.min_by("payload", F.struct("at", "rank")).alias("payload"),
    )
    share = lambda w, r: F.coalesce(F.lit(float(w)) / (config.rrf_k + F.col(r)), F.lit(0.0))
    score = share(config.dense_weight, "dense_rank") + share(config.sparse_weight, "sparse_rank")
    return out.select("qid", "chunk_id", "dense_rank", "dense_score", "sparse_rank", "sparse_score", score.alias("rrf_score"), "source_channels", *[F.col(f"payload.{c}").alias(c) for c in payload])


def fused_order():
    from pyspark.sql import Window

    return Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc("chunk_id"))


def top_fused(fused: DataFrame, k: int | Column) -> DataFrame:
    """The best ``k`` fused rows of a question with ``pos`` from 1."""
    return fused.withColumn("pos", F.row_number().over(fused_order()).cast("long")).filter(F.col("pos") <= k)
