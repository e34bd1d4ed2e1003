"""Retrieval completion: seeds, the chunks that share a paragraph with them, and the ordered result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import strip
from quillstream.operators.channels import matches


def seeds(fused_top: DataFrame) -> DataFrame:
    """(qid, chunk_id, seed_rank from 0) of fused rows with ``pos``: ids stripped, blanks and repeats dropped.

    Positions are those before the drop, as the sibling scan numbers its parameter list.
    """
    rows = fused_top.select("qid", strip(F.col("chunk_id")).alias("chunk_id"), "pos").filter(F.length("chunk_id") > 0)
    first = rows.groupBy("qid", "chunk_id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("qid").orderBy("pos")
    return first.select("qid", "chunk_id", (F.row_number().over(w) - 1).cast("long").alias("seed_rank"))


def siblings(seed_rows: DataFrame, derived_from: DataFrame, chunks: DataFrame, limit: int, filters: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, seed_rank, part_index): searchable chunks of a seed's paragraphs that are no seeds.

    A sibling of several seeds goes to the first.  ``limit`` is per question over all seeds, in order of
    (seed_rank, part_index nulls last, chunk_id).  Inactive chunks are not excluded here.
    """
    if limit == 0:
        return seed_rows.select("qid", "chunk_id", "seed_rank", F.lit(None).cast("int").alias("part_index")).limit(0)
    hop = seed_rows.join(derived_from, "chunk_id").select("qid", "seed_rank", "paragraph_id")
    reached = hop.join(derived_from, "paragraph_id").groupBy("qid", "chunk_id").agg(F.min("seed_rank").alias("seed_rank"))
    found = reached.join(seed_rows.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    rows = found.join(chunks.select("chunk_id", "standard_id", "zone", "searchable", "part_index"), "chunk_id").filter(F.coalesce("searchable", F.lit(False)))
    if filters is not None:
        rows = rows.join(filters, "qid").filter(matches("want_standard", "standard_id") & matches("want_zone", "zone"))
    w = Window.partitionBy("qid").orderBy("seed_rank", F.asc_nulls_last("part_index"), "chunk_id")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("qid", "chunk_id", "seed_rank", "part_index")


def interleave(seed_rows: DataFrame, sibling_rows: DataFrame) -> DataFrame:
    """(qid, pos from 1, chunk_id, candidate_source, seed_rank): each seed, then its siblings."""
    none = F.lit(None).cast("int")
    a = seed_rows.select("qid", "chunk_id", "seed_rank", F.lit("hybrid").alias("candidate_source"), F.lit(0).alias("kind"), none.alias("part_index"))
    b = sibling_rows.select("qid", "chunk_id", "seed_rank", F.lit("sibling").alias("candidate_source"), F.lit(1).alias("kind"), "part_index")
    w = Window.partitionBy("qid").orderBy("seed_rank", "kind", F.asc_nulls_last("part_index"), "chunk_id")
    return a.unionByName(b).select("qid", F.row_number().over(w).cast("long").alias("pos"), "chunk_id", "candidate_source", "seed_rank")


def metrics(questions: DataFrame, raw: DataFrame | None, fused_top: DataFrame, results: DataFrame) -> DataFrame:
    """Counts per question; without scored channels (``raw`` None) the raw count is null and nothing is said to be filtered.

    ``seed_count`` counts fused rows before blanks and repeats are dropped.
    """
    q = questions.select("qid")
    n_seeds = fused_top.groupBy("qid").agg(F.count("*").alias("seed_count"))
    n_rows = results.groupBy("qid").agg(F.count("*").alias("result_count"), F.count_if(F.col("candidate_source") == "sibling").alias("sibling_count"))
    out = q.join(n_seeds, "qid", "left").join(n_rows, "qid", "left").na.fill(0, ["seed_count", "result_count", "sibling_count"])
    if raw is None:
        out = out.withColumn("raw_candidate_count", F.lit(None).cast("long"))
    else:
        n_raw = raw.filter(F.length("chunk_id") > 0).groupBy("qid").agg(F.count_distinct("chunk_id").alias("raw_candidate_count"))
        out = out.join(n_raw, "qid", "left").na.fill(0, ["raw_candidate_count"])
    filtered = F.coalesce((F.col("raw_candidate_count") > 0) & (F.col("seed_count") == 0), F.lit(False))
    return out.select("qid", "raw_candidate_count", "seed_count", "sibling_count", "result_count", filtered.alias("threshold_filtered_all"))
