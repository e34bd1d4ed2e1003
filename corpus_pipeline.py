"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens; each stage reads what the last one wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import toxicity as tox
from quillstream.llm.bpe import bpe_encode
from quillstream.llm.common import load, shared_dir
from quillstream.llm.jaccard_join import ngram_jaccard_join
from quillstream.llm.line_dedup import line_dedup
from quillstream.llm.mixing import mixing_rates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    rows = docs.select(*COLUMNS)
    return tox.without_toxic(rows, tox.fit(rows, load(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last one; documents stay, if with less text."""
    return line_dedup(docs, carry=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = ngram_jaccard_join(docs, words=5, pct=80)
    losers = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("loser")).distinct()
    return docs.join(losers, docs["doc_id"] == losers["loser"], "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are brought to tempered shares by repeating documents; none is dropped."""
    rates = mixing_rates(docs, docs, min_rate=1.0)
    copies = rates.groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["id"]), "left")
    return joined.withColumn("copy", F.explode(F.expr("array_repeat(0, int(coalesce(copies, 1)))"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    import public_tokenizers

    coded = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages score by fitted models, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
