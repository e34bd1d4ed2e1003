"""Line dedup: lines that several documents hold stay only in the last of them.

DataFrame functions only.  Lines are exploded once with their positions, as 128-bit hashes of their normalised
form, into a narrow table; documents per hash are counted with map-side partial aggregation, so a line that a
third of all documents hold arrives as one partial row per task.  Only hashes over the threshold join back: the
most common of them are broadcast, as many as their share of all rows allows, so no task gathers the rows of one
line.  The positions to drop are gathered by text, and the text itself is shuffled once, when each document meets
its positions.  What lies between them is put together again in order of position: time is linear in the lines.

Defined results: a null or empty text is one empty line; repeated rows of one doc_id count as one document and
lose the same lines; a null doc_id is never the keeper of a line and counts in no total; empty tables give
empty results; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import materialize, met

#: Characters stripped at both ends of a line's key.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; lower() does just that where every character is one byte."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIPPED))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: ``id_col``, text (kept lines), n_lines, n_dropped, and the columns named in ``carry``.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines
    everywhere but in the largest id that holds it.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    # rows of one id are told apart by their text
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried")).withColumn("t", F.xxhash64("text"))
    keys = rows.select("id", "t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).select("id", "t", "pos", line_key(F.col("line")).alias("key"))
    low = ascii_lower(F.col("key"))
    held = keys.filter(F.length("key") >= min_chars).select("id", "t", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit("line"), low).alias("h2"))
    held = materialize(held, "lines")
    common = (
        held.groupBy("h1", "h2")
        .agg(F.count_distinct("id").alias("n_docs"), F.count("*").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "n", "keeper")
    )
    drops = (
        met(held, materialize(common, "common", True), ["h1", "h2"], "n")
        .filter(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
        .groupBy("id", "t")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "gone")
    )
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    # exploding an array of one array makes the lines a column, which isn't computed again for each piece
    split = joined.select("id", "carried", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.explode(F.array(lines_of(F.col("text")))).alias("lines"))
    first = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    end = F.concat(F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(first, end, lambda a, b: F.slice(F.col("lines"), a + 1, b - a)))
    return split.select(
        F.col("id").alias(id_col),
        F.array_join(F.when(F.size("gone") > 0, kept).otherwise(F.col("lines")), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        *[F.col(f"carried.{c}") for c in carry],
    )


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM d),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
k AS (SELECT doc_id, line, pos,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE c.key IS NULL OR k.doc_id = c.keeper), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
