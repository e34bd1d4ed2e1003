"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the code points of a normalised text (lower case, runs of other than
letters as one blank).  Document frequencies come from all documents that may be learned from, one pass that
yields a bounded vector of counts per task.  Weights are trained by follow-the-regularised-leader (per-coordinate
rates) with L1 and L2 penalties, on a bounded sample of labelled rows (``per_language`` of each language, lowest
hash first), which one pass chooses and a second reduces to features on the executors; a fifth of the sample is
set aside to fit the temperature that calibrates the probabilities.

The model (buckets x languages weights) is broadcast: its size is fixed by parameters.  Texts are scored whole,
in one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when there is
nothing to learn from; a single known language is predicted with score 1; a language beyond the ``LANGUAGES`` most
frequent is never predicted; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import lowest, mapped, ship, slices, texts
from quillstream.llm.toxicity import remainder

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
#: Labelled rows per language, and languages (the most frequent), that the model is fitted on at most.
PER_LANGUAGE, LANGUAGES = 600, 256
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 4
_SALT = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def normalise(text: str) -> np.ndarray:
    """Code points of a text in lower case, with anything but letters as single blanks; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return codes
    inner = letters()[codes]
    before = np.concatenate(([False], inner[:-1]))
    out = np.where(inner, codes, np.uint32(0x20))[inner | before]
    return np.concatenate((np.array([0x20], dtype=np.uint32), out)) if inner.any() else codes[:0]


def counts(codes: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram occurs in a normalised text."""
    wide, found = codes.astype(np.uint64), []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in SIZES:
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + wide[n - 1 :] + np.uint64(n)) * _SALT
        found.append(((h ^ (h >> np.uint64(29))) * _M1) >> np.uint64(50))
    return np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS) if found else np.zeros(BUCKETS, dtype=np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of a text's features."""
    c = counts(normalise(text))
    i = np.nonzero(c)[0]
    return i, c[i]


def tfidf(i: np.ndarray, c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and unit weights of features."""
    x = (1 + np.log(c)) * idf[i]
    norm = np.sqrt((x * x).sum())
    return i, x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """Fitted on (language, features, counts) rows with document frequencies of the corpus."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int):
        self.languages = sorted({lang for lang, _, _ in rows})
        self.idf = np.log((n_docs + 1) / (df + 1)) + 1
        self.weights = np.zeros((BUCKETS, len(self.languages)))
        self.temperature = 1.0
        if len(self.languages) > 1:
            self._train(rows)

    def _train(self, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        rng = np.random.default_rng(7)
        at = {lang: i for i, lang in enumerate(self.languages)}
        feats = [(tfidf(i, c, self.idf), at[lang]) for lang, i, c in rows if len(i)]
        order = rng.permutation(len(feats))
        n_held = len(feats) // 5
        held, train = order[:n_held], order[n_held:]
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)

        def leader(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
            return np.where(np.abs(zi) <= L1, 0.0, w)

        for _ in range(EPOCHS):
            for r in rng.permutation(train):
                (i, x), y = feats[r]
                w = leader(i)
                p = softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p[None, :]
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
                z[i] += g - sigma * w
                n[i] += g * g
        self.weights = leader(np.arange(BUCKETS))
        if n_held:
            logits = np.array([x @ self.weights[i] for (i, x), _ in (feats[r] for r in held)])
            y = np.array([feats[r][1] for r in held])

            def loss(t: float) -> float:
                p = softmax(logits / t)[np.arange(len(y)), y]
                return -np.log(np.maximum(p, 1e-12)).mean()

            grid = np.geomspace(0.05, 5, 60)
            self.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])

    def posteriors(self, text: str) -> np.ndarray | None:
        """Calibrated probabilities of the languages; None without a letter or a language."""
        i, c = features(text)
        if not len(i) or not self.languages:
            return None
        i, x = tfidf(i, c, self.idf)
        return softmax((x @ self.weights[i]) / self.temperature)

    def predict(self, text: str) -> tuple[str, float]:
        p = self.posteriors(text)
        if p is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: documents per hashed n-gram, and documents (bucket -1), of a task."""
    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for whole in batches:
        for batch in slices(whole, 0):
            for t in texts(batch.column(0)):
                df += counts(normalise(t)) > 0
                n += 1
    used = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(df[used], n), pa.int64())], names=["bucket", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from rows that aren't held out and have a language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null").filter(remainder(F.col("id")) != 2)
    total = rows.select("text").transform(mapped, _frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    for r in total:  # BUCKETS rows at most
        if r.bucket >= 0:
            df[r.bucket] = r.n
    n_docs = next((r.n for r in total if r.bucket < 0), 0)
    langs = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    sample = lowest(rows.select("id", "lang").filter(F.col("lang").isin(*langs)), "lang", langs, per_language)
    picked = docs.sparkSession.createDataFrame(sorted({(r.id,) for r in sample if r.id is not None}), "id long")  # LANGUAGES * per_language rows at most
    chosen = rows.join(F.broadcast(picked), "id").filter(F.col("lang").isin(*langs)).select("id", "lang", "text")
    got = chosen.transform(mapped, _features, "id long, lang string, i binary, c binary").collect()
    examples = sorted((r.id, r.lang, bytes(r.i), bytes(r.c)) for r in got)
    return LanguageModel([(lang, np.frombuffer(i, dtype=np.int16).astype(np.int64), np.frombuffer(c, dtype=np.int32)) for _, lang, i, c in examples], df, n_docs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: (id, lang, features, counts) of rows (id, lang, text)."""
    for whole in batches:
        for batch in slices(whole, 2):
            got = [features(t) for t in texts(batch.column(2))]
            packed = [pa.array([x[j].astype(kind).tobytes() for x in got], pa.binary()) for j, kind in ((0, np.int16), (1, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["id", "lang", "i", "c"])


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                got = [m.predict(t) for t in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(mapped, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op8_language_id(docs: DataFrame) -> DataFrame:
    return language_id(docs, fit(docs)).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
