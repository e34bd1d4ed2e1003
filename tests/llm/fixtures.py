"""Awkward rows that every operator has to take: nulls, empties, long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(12_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "src0", 10),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "src0", 10),
    (2, "the quick brown fox jumps over the lazy dog again", "en", "src0", 10),
    (3, None, None, None, None),
    (4, "", "en", "src1", 0),
    (None, "a text without an id password=abcdef123456", "fr", None, 5),
    (5, LONG, "en", "src1", len(LONG)),
    (6, LONG + " tail", None, "src1", 1),
    (7, " \t\n\n ", "de", "src2", 4),
    (8, "éÀ ß\n中文 🙂 line\nthis line repeats in documents\n<|endoftext|>", "fr", "src2", 7),
    (9, "this line repeats in documents\nunique nine", "fr", "src2", 7),
    (10, "  THIS line repeats in documents \nunique ten", "fr", "src2", 7),
    (11, "12345 !!! ---", "es", "src2", 7),
    (12, "one two three", "es", "src2", 7),
    (13, "one two three", "es", "src3", 7),
]


def awkward(spark):
    """The rows, with further columns named as operators name theirs."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "key", "bits", "bucket", "keeper", "drops", "set_id", "score", "p", "h1", "carried", "copies"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
