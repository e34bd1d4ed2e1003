"""The driver's tables as a corpus: chunks, paragraph edges, vectors, questions, request and job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import or_else
from quillstream.schemas import ZONES

LANGUAGE_STANDARD = {"de": "1032", "en": "1039", "es": "1107", "fr": "1109"}
#: How event types stand for calls on the job store.
JOB_CALLS = {"signup": "create", "purchase": "finish", "error": "fail", "view": "get", "click": "delete"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_id(c):
    digits = c.cast("string")
    return F.concat(F.lit("D"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), F.lit("0")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("searchable"), (F.col("toxic") == 1).alias("inactive"))
    zones = F.array(*map(F.lit, ZONES))
    zone = F.element_at(zones, (F.substring("source", 4, 9).try_cast("int") % len(ZONES) + 1).cast("int"))
    std = F.create_map(*[F.lit(x) for kv in LANGUAGE_STANDARD.items() for x in kv])[F.col("lang")]
    label = F.when(F.col("doc_id") % 5 == 1, F.lit(" ")).when(F.col("doc_id") % 5 > 1, F.concat(F.lit("문단 "), F.col("doc_id").cast("string")))
    tagged = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("["), std, F.lit("]\n"), F.col("text")))
    page = (F.col("doc_id") % 300 + 1).cast("int")
    rows = d.select(
        "doc_id", chunk_id(F.col("doc_id")).alias("chunk_id"), std.alias("standard_id"), zone.alias("zone"), F.lit("paragraph").alias("chunk_type"),
        "text", tagged.alias("contextualized_text"), label.alias("citation_label"), page.alias("pdf_page_start"), (page + 1).alias("pdf_page_end"),
        F.lit(3).alias("search_priority"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 3).cast("int")).alias("part_index"),
    )
    rows = rows.withColumn("index_text", or_else(F.col("contextualized_text"), F.col("text")))
    return rows.join(labels, "doc_id", "left")


def derived_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, paragraph_id): three chunks a paragraph; every tenth chunk belongs to the next one too."""
    at = F.floor(F.col("doc_id") / 3)
    both = F.when(F.col("doc_id") % 10 == 0, F.array(at, at + 1)).otherwise(F.array(at))
    return table(spark, sf_dir, "documents").select(chunk_id(F.col("doc_id")).alias("chunk_id"), F.explode(both).alias("p")).select("chunk_id", F.concat(F.lit("P"), F.col("p").cast("string")).alias("paragraph_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, embedding) of the vectors whose document exists."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").select(chunk_id(F.col("doc_id")).alias("chunk_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, embedding, want_standard, want_zone, top_k)."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    zones = F.array(*map(F.lit, ZONES))
    return b.join(v, "qid", "left").select(
        "qid", "question", "embedding",
        F.when(F.col("qid") % 3 == 0, F.lit("1039")).alias("want_standard"),
        F.when(F.col("qid") % 4 == 1, F.element_at(zones, (F.col("qid") % len(ZONES) + 1).cast("int"))).alias("want_zone"),
        (F.col("qid") % 15 + 1).alias("top_k"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, id, us, op); ids of one key reach it within minutes, so that lifetimes matter."""
    calls = F.create_map(*[F.lit(x) for kv in JOB_CALLS.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), calls[F.col("event_type")].alias("op"))
