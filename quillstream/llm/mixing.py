"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table (document, domain) gives every document its posterior over domains; a
document of t tokens sampled at rate r is expected to bring r t p_d tokens to domain d.  Nonnegative rates are
fitted so that these totals match the targets, by projected-gradient least squares: residuals are measured in
the metric of the inverse Gram matrix of the documents (so one step solves the problem where no rate is
clipped), documents in that of their tokens, and each step ends with a projection onto rates >= ``min_rate``.

Distribution: one pass writes (id, tokens, posterior); a step sends the short list of past step vectors to all
tasks, which replay it (the state of a document is a function of its posterior and that list) and return one
sum per domain and task.  Nothing per document reaches the driver.

Defined results: documents without a posterior (no letter, or nothing to learn from) keep the rate 1, or
``min_rate`` if that is more; a domain whose target is 0 is pushed down as far as rates allow; targets that
cannot be met are met as closely as the metric allows; null ids get rates like others; rows that repeat an id
are fitted each; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import langid
from quillstream.llm.common import mapped, materialize, ship, slices, texts

#: Steps at most; a share of the budget that counts as met or as no change, and one that is worth a warning.
STEPS, TOLERANCE, MISSED = 25, 1e-6, 1e-3
#: Targets are proportional to the present shares to this power unless given.
POWER = 0.7


def replay(p: np.ndarray, steps: np.ndarray, min_rate: float) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the given steps."""
    r = np.full(len(p), max(1.0, min_rate))
    for s in steps:
        r = np.maximum(min_rate, r + p @ s)
    return r


def _posteriors(batches: DataFrame, model: langid.LanguageModel) -> DataFrame:
    spark = batches.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in parts:
            for batch in slices(whole, 1):
                rows = texts(batch.column(1))
                p = [m.posteriors(t) for t in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.split()) for t in rows], pa.int64()), pa.array([None if x is None else x.tolist() for x in p], pa.list_(pa.float64()))],
                    names=["id", "tokens", "p"],
                )

    return batches.transform(mapped, run, "id long, tokens long, p array<double>")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _totals(table: DataFrame, steps: np.ndarray, d: int, min_rate: float, gram: bool) -> np.ndarray:
    """Sums over documents: expected tokens by domain, or the Gram matrix."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d if gram else d)
        for batch in parts:
            p, t = _matrix(batch.column(1), d), batch.column(0).to_numpy().astype(float)
            total += ((p * t[:, None]).T @ p).ravel() if gram else (replay(p, steps, min_rate) * t) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "x"])

    sums = table.filter("p is not null").select("tokens", "p").transform(mapped, run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(d * d if gram else d)
    for r in sums:
        out[r["at"]] = r.x
    return out.reshape(d, d) if gram else out


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | None = None,
    budget: float | None = None,
    min_rate: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "lang",
) -> DataFrame:
    """id_col, tokens, posterior, rate, copies (the rate rounded by a hash of the id, so that it holds on average).

    ``labelled`` has id_col, text_col and domain_col.  ``targets`` are weights by domain; ``budget`` is the number of
    tokens wanted, by default the present one, or with ``min_rate`` > 0 the least that no domain has to shrink for.
    """
    spark = docs.sparkSession
    ship(spark)
    model = langid.fit(labelled, id_col=id_col, text_col=text_col, lang_col=domain_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = materialize(_posteriors(rows, model), "posteriors")
    d = len(model.languages)
    steps = np.zeros((0, d))
    if d:
        now = _totals(table, steps, d, 0.0, False)
        wanted = np.array([float(targets.get(x, 0.0)) for x in model.languages]) if targets else (now / max(now.sum(), 1)) ** POWER
        weights = wanted / wanted.sum() if wanted.sum() else np.full(d, 1 / d)
        if budget is None:
            budget = now.sum() if min_rate <= 0 else max((x / w for x, w in zip(now, weights, strict=True) if w > 0), default=0.0)
        goal = weights * budget
        inverse = np.linalg.pinv(_totals(table, steps, d, 0.0, True), rcond=1e-9, hermitian=True)
        missed, last = 0.0, None
        for _ in range(STEPS):
            rest = goal - _totals(table, steps, d, min_rate, False)
            missed = float(np.abs(rest).max()) / max(budget, 1)
            if missed <= TOLERANCE or (last is not None and np.abs(rest - last).max() <= TOLERANCE * max(budget, 1)):
                break  # met, or as near as rates of the least size allow
            steps, last = np.vstack([steps, inverse @ rest]), rest
        if missed > MISSED:
            warnings.warn(f"targets are missed by up to {missed:.2%} of the budget", stacklevel=2)
        unknown = sorted(set(targets or ()) - set(model.languages))
        if unknown:
            raise ValueError(f"no labelled rows of the domains {unknown}")
    schedule = spark.sparkContext.broadcast(steps)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = schedule.value
        for batch in parts:
            has = np.asarray(batch.column(2).is_valid())
            rate = np.full(batch.num_rows, max(1.0, min_rate))
            if has.any():
                rate[has] = replay(_matrix(batch.column(2).filter(pa.array(has)), d), s, min_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(rate, 9))], names=["id", "tokens", "posterior", "rate"])

    out = table.transform(mapped, run, "id long, tokens long, posterior array<double>, rate double")
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumnRenamed("id", id_col)


def op2_mixing(docs: DataFrame) -> DataFrame:
    return mixing_rates(docs, docs).select("doc_id", "tokens", "rate", "copies")
