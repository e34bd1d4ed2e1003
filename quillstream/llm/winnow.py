"""Document fingerprints by winnowing.

Hashes of all k-grams of code points roll over a text; of each window of w hashes the minimum is chosen, the
rightmost of equals, and kept with its position.  Two texts that share k + w - 1 code points in a row share a
chosen hash; no run shorter than k is ever matched.  All steps are array passes of doubling width, so a text
costs O(n log w) whatever it holds.

A document is compared with its successor by id without a global sort: ids are cut into fine ranges at approximate
quantiles, of which one small aggregate tells the bytes and the smallest id; neighbours are put together to ranges
of about equal bytes, and a range's first document is dealt to the preceding range as well.  Text is shuffled once,
a range to a partition; tasks stream their sorted rows.  Boundaries are in the plan as a single literal each.

Defined results: a null text is the empty text, whose fingerprint is the empty string; a text shorter than k has
one hash, of all of it; likeness is the Jaccard index of the hash sets, 1 for two empty ones; null ids come
first; rows that repeat an id follow each other by text; a single row is its own successor.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import ship, slices, texts
from quillstream.llm.shingles import mix

K, W = 12, 16
#: Fine ranges of ids for each range that is dealt.
FINE = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, in the high half of 64 bits; of the whole text if it is shorter."""
    k = min(k, len(codes))
    h = mix(codes.astype(np.uint64) + BASE)
    out, have, left = None, 0, k
    width, factor = 1, int(BASE)
    while left:  # a k-gram is put together from power-of-two pieces
        if left & 1:
            n = len(codes) - k + 1
            piece = h[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(factor) + piece
            have += width
        left >>= 1
        if left:
            h = h[:-width] * np.uint64(factor) + h[width:]
            width, factor = width * 2, factor * factor % 2**64
    return mix(out) & ~_LOW


def winnow(text: str, k: int = K, w: int = W) -> np.ndarray:
    """Chosen (hash << 32 | position) values in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.empty(0, dtype=np.uint64)
    h = kgram_hashes(codes, k)
    # the later position sorts first among equal hashes
    h |= _LOW - np.arange(len(h), dtype=np.uint64)
    w = min(w, len(h))
    low, width = h, 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (chosen & ~_LOW) | (_LOW - (chosen & _LOW))


def hashes(prints: np.ndarray) -> np.ndarray:
    return np.unique(prints >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted hash sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(prints: np.ndarray) -> str:
    """16 hex digits a print: hash, position."""
    return prints.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, text, real) sorted; each real row is compared with the row after it."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None

    def compared(this, following):
        bucket, id_, text, own, real = this
        changed = edited(text, following[2])
        other = winnow(changed)
        mine = hashes(own)
        return (
            id_, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other),
            likeness(mine, hashes(other)), likeness(mine, hashes(following[3])),
        )

    for whole in batches:
        for batch in slices(whole, 2):
            out = []
            for bucket, id_, text, real in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                row = (bucket, id_, text, winnow(text), real)
                if held is not None and held[4]:
                    assert held[0] == bucket, "a range ends without its successor"
                    out.append(compared(held, row))
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    # the order of rows: id (null first), then a hash of the text for rows that repeat an id
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    n = ranges or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    fine = FINE * n
    cuts = rows.agg(F.percentile_approx("key", [i / fine for i in range(1, fine)], 10 * fine).alias("c")).first().c
    names = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if cuts is None:
        return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
    dealt = rows.withColumn("fine", _range_of(F.col("key"), sorted(set(cuts)))).withColumn("tie", F.xxhash64("text"))
    # a row a fine range: bounded by the number of partitions
    seen = sorted(dealt.groupBy("fine").agg(F.sum(F.octet_length("text") + 64).alias("size"), F.min(F.struct("key", "tie")).alias("first")).collect())
    total, upto, merged, firsts, last = sum(r["size"] for r in seen), 0, [0] * (len(cuts) + 1), [], None
    for r in seen:
        here = upto * n // total
        if here != last:
            firsts.append(r["first"])
            last = here
        merged[r["fine"]] = len(firsts) - 1
        upto += r["size"]
    bucket = F.get(_literal(merged, "int"), F.col("fine"))
    at = F.col("bucket")
    is_first = (F.get(_literal([f.key for f in firsts], "long"), at) == F.col("key")) & (F.get(_literal([f.tie for f in firsts], "long"), at) == F.col("tie"))
    own = F.struct(at.alias("b"), F.lit(True).alias("real"))
    # the first range's first row closes the last range
    back = F.struct(F.pmod(at - 1, F.lit(len(firsts))).alias("b"), F.lit(False).alias("real"))
    copies = F.when(is_first, F.array(own, back)).otherwise(F.array(own))
    spread = dealt.withColumn("bucket", bucket).select("key", "id", "text", "tie", F.explode(copies).alias("c")).select("c.b", "key", "id", "text", "tie", "c.real")
    sorted_rows = spread.repartitionById(len(firsts), F.col("b")).sortWithinPartitions("b", F.desc("real"), "key", "tie").select("b", "id", "text", "real")
    return sorted_rows.mapInArrow(_rows, names).withColumnRenamed("id", id_col)


def _literal(values: list, kind: str) -> Column:
    """An array as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are not above the key, by a search in two steps."""
    step = max(1, math.isqrt(len(cuts)))
    heads = cuts[::step]
    upto = F.size(F.filter(_literal(heads, "long"), lambda c: c <= key))
    rest = F.get(_literal([[], *(cuts[i : i + step] for i in range(0, len(cuts), step))], "array<long>"), upto)
    return F.when(upto == 0, F.lit(0)).otherwise((upto - 1) * step + F.size(F.filter(rest, lambda c: c <= key)))


def op3_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
