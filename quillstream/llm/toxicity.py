"""Toxicity by nearest labelled examples: exact TF-IDF cosine with all examples over all their terms.

Terms are words and word prefixes, as 64-bit hashes.  Every example (a bounded sample of labelled rows,
``per_label`` of each label, lowest hash first) is indexed by all its terms; a term weighs its frequency in the text
times its inverse document frequency, which is lowered, down to ``FLOOR``, unless its log-odds between the labels is surely high, so cosine rests on what
tells the labels apart where a text has such terms, and on the bulk of its words where it has none.

The index is inverted and block-max.  The postings of a text's seldom terms are summed for all examples.
Examples are laid out by clusters of their frequent terms and cut into blocks, and for each frequent term and
block the highest weight is known: the text's weights times these maxima, on top of the block's highest sum,
bound its cosines with the examples of a block.  The blocks of highest bound are scored first (as products of
matrices, in single precision); the k-th best cosine so far then excludes all blocks whose bound is below it.
All that may be among the k nearest are computed again in double precision: the k nearest are exact.  Their
distance-weighted vote, with classes weighted by their share among all labelled rows, is calibrated by a
logistic fit on leave-one-out votes; the neighbours are the evidence.

Examples are reduced to their terms on the executors, which also cast the leave-one-out votes.  The model is
small whatever the corpus (bounded examples), so it is broadcast; texts are scored whole, in one pass without a
shuffle.

Defined results: a null or empty text, or one without a term of any example, gets the rate of such examples (0 where
the sample has none) and no evidence; without labelled rows of both kinds every score is 0; a document labelled
more than once is toxic if any row says so; rows that repeat an id are scored each; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import lowest, mapped, ship, slices, texts, trim
from quillstream.llm.shingles import mix, power_table

#: Labelled rows of each label that a model is fitted on at most.
PER_LABEL = 4000
#: A term's weight is its inverse document frequency times a factor from FLOOR to 1, 1 where the lower bound of
#: its log-odds is LOG_ODDS or more.
FLOOR, LOG_ODDS = 0.05, 3.5
PREFIXES = (4, 5, 6)
NEIGHBOURS = 16
#: Terms in more than one of so many examples are frequent: their scores are products of matrices.
DENSE = 16
#: Examples of a block; clusters that the layout starts from; blocks scored before any is excluded; texts at once.
BLOCK, CLUSTERS, FIRST, TEXTS = 64, 16, 4, 256
#: More than the relative error of a cosine (a sum of non-negative products) in single precision.
SLACK = 2.5e-4
#: The least positive number here.
TINY = np.float32(1e-30)
#: Power by which votes fall with the cosine relative to the nearest example.
SHARPNESS = 6
#: Votes' weight of the prior.
SMOOTHING = 0.25
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) % 2**64) for i in range(len(PREFIXES) + 1)]
_lower: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """For each code point its lower case if it is a letter or digit, else 0."""
    if not _lower:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalnum():
                table[c] = ord(x.lower()[0])
        _lower.append(table)
    return _lower[0]


def term_hashes(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each term of each text: every word (letters and digits, lower case), and its prefixes."""
    codes = np.frombuffer("\n".join([*rows, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = lower_table()[codes]
    inner = low > 0
    edge = np.diff(np.concatenate(([False], inner, [False])).view(np.int8))
    first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(first):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in rows]), first, "right")
    size = end - first
    value = mix(low[inner].astype(np.uint64) + _SEEDS[0])
    at = np.cumsum(size) - size  # words in ``value``
    power = power_table(int(size.max()))
    whole = np.add.reduceat(value * power[np.arange(len(value)) - np.repeat(at, size)], at)
    owners, found = [owner], [mix(whole + _SEEDS[0])]
    upto, words = np.zeros(len(at), dtype=np.uint64), np.arange(len(at))
    for i in range(max(PREFIXES)):
        longer = size[words] > i
        words, upto = words[longer], upto[longer]
        upto = upto + value[at[words] + i] * power[i]
        if i + 1 in PREFIXES:
            owners.append(owner[words])
            found.append(mix(upto + _SEEDS[1 + PREFIXES.index(i + 1)]))
    return np.concatenate(owners), np.concatenate(found)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct term hashes of a text, ascending, and their counts."""
    h, n = np.unique(term_hashes([text])[1], return_counts=True)
    return h, n.astype(np.int32)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class HashTable:
    """Positions of distinct hashes, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 3).bit_length())
        self.keys, self.mask = keys, np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), keys.astype(np.int64) & self.mask
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 for unknown ones."""
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        left, at = np.arange(len(h)), h.astype(np.int64) & self.mask
        while len(left):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == h[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & self.mask
        return out


class ExampleIndex:
    """Unit vectors of examples in blocks: block maxima and postings by term, and by example for exact cosines."""

    def __init__(self, size: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray):
        """Of each example, one after the other, ``size`` terms and their counts; ``weight`` is of each term."""
        self.weight, self.n = weight, len(size)
        self.order = self._layout(terms, size)  # of each position in the blocks the example
        at = ranges((np.cumsum(size) - size)[self.order], size[self.order])
        self.size, self.terms, self.counts = size[self.order], terms[at], counts[at]

    def __getstate__(self) -> bytes:
        """Only what the rest is built from, compressed: a broadcast is on disk more than once."""
        return zlib.compress(pickle.dumps((self.weight, self.order, self.size, self.terms, self.counts), protocol=5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.weight, self.order, self.size, self.terms, self.counts = pickle.loads(zlib.decompress(state))
        self.n = len(self.size)

    def ready(self) -> None:
        """Build the postings and matrices, where the index is searched; the driver only ships it."""
        if not hasattr(self, "matrix"):
            self._build()
            trim()

    @staticmethod
    def _layout(terms: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Examples that share frequent terms next to each other: clusters by a few rounds of spherical k-means."""
        n = len(size)
        if n <= BLOCK:
            return np.arange(n)
        df = np.bincount(terms)
        often = np.argsort(-df, kind="stable")[:512]
        column = np.full(len(df), -1, dtype=np.int16)
        column[often] = np.arange(len(often))
        some = np.nonzero(column[terms] >= 0)[0]
        row, at = np.searchsorted(np.cumsum(size), some, "right"), column[terms[some]]
        m = np.zeros((n, len(often)), dtype=np.float32)
        m[row, at] = np.log((n + 1) / df[terms[some]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        centre = m[np.random.default_rng(1).choice(n, min(n, CLUSTERS), replace=False)]
        for _ in range(8):
            near = np.argmax(m @ centre.T, axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, near, m)
            centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        return np.lexsort((np.arange(n), -(m * centre[near]).sum(axis=1).round(4), near))

    def _build(self) -> None:
        self.tie = self.order.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        df = np.bincount(self.terms, minlength=len(self.weight))
        often = np.nonzero(df * DENSE > self.n)[0]
        self.blocks = -(-self.n // BLOCK)
        self.column = np.full(len(self.weight), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        self.matrix, self.norm = np.zeros((self.n, len(often)), dtype=np.float32), np.zeros(self.n)
        terms, rows, values = [], [], []  # of the postings of seldom terms
        kind = np.int16 if self.n < 1 << 15 else np.int32
        for a in range(0, self.n, 256):
            b = min(a + 256, self.n)
            here = slice(self.first[a], self.first[b - 1] + self.size[b - 1])
            row = np.repeat(np.arange(a, b), self.size[a:b])
            x = self.counts[here] * self.weight[self.terms[here]]
            self.norm[a:b] = np.sqrt(np.bincount(row - a, x * x, b - a))
            x = (x / self.norm[row]).astype(np.float32)
            at = self.column[self.terms[here]]
            wide = at >= 0
            self.matrix[row[wide], at[wide]] = x[wide]
            for part, of in ((terms, self.terms[here]), (rows, row.astype(kind)), (values, x)):
                part.append(of[~wide])
        edge = np.arange(0, self.n, BLOCK)
        self.tops = np.maximum.reduceat(self.matrix, edge, axis=0).T.copy() if self.n else self.matrix.T
        by_term = np.argsort(np.concatenate([self.terms[:0], *terms]), kind="stable").astype(np.int32)
        del terms
        self.docs = np.concatenate([np.empty(0, dtype=kind), *rows])[by_term]
        del rows
        self.values = np.concatenate([self.matrix[:0, :0].ravel(), *values])[by_term]
        self.df = np.where(self.column < 0, df, 0)
        self.start = np.cumsum(self.df) - self.df

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each unit vector (terms, values) the cosines and examples of the k highest positive cosines, ties to the smaller example."""
        self.ready()
        n_q, edge = len(queries), np.arange(0, self.n, BLOCK)
        often, sums = np.zeros((n_q, self.matrix.shape[1]), dtype=np.float32), np.zeros((n_q, self.n), dtype=np.float32)
        for q, (t, x) in enumerate(queries):
            at = self.column.take(t)
            wide = at >= 0
            often[q, at[wide]] = x[wide]
            t, x = t[~wide], x[~wide].astype(np.float32)
            size = self.df.take(t)
            at = ranges(self.start.take(t), size)
            sums[q] = np.bincount(self.docs.take(at), self.values.take(at) * np.repeat(x, size), self.n)
        # no cosine with an example of a block is above its bound
        bound = (np.maximum.reduceat(sums, edge, axis=1) + often @ self.tops) * (1 + SLACK)
        valid, floor = np.zeros((n_q, self.blocks * BLOCK), dtype=np.float32), np.zeros(n_q)
        seen = np.zeros(bound.shape, dtype=bool)
        for last in (FIRST, 4 * FIRST, self.blocks):
            want = (bound >= floor[:, None]) & (bound > 0) & ~seen
            if last < self.blocks:  # of these the ones of highest bound
                high = np.argpartition(np.where(want, -bound, 0), last - 1, axis=1)[:, :last]
                chosen = np.zeros_like(want)
                np.put_along_axis(chosen, high, True, axis=1)
                want &= chosen
            seen |= want
            if not want.any():
                continue
            for b in np.nonzero(want.any(axis=0))[0]:
                q = np.nonzero(want[:, b])[0]
                here = slice(b * BLOCK, min((b + 1) * BLOCK, self.n))
                valid[q, here] = sums[q, here] + often[q] @ self.matrix[here].T
            if skip:
                valid[np.arange(n_q), skip] = 0
            if last == FIRST < self.blocks and last * BLOCK > k:  # all texts at once: few blocks each
                some = np.take_along_axis(valid.reshape(n_q, self.blocks, BLOCK), high[:, :, None], axis=1).reshape(n_q, -1)
                floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] * (1 - SLACK)
                continue
            for q in range(n_q):
                high = valid[q][valid[q] >= max(floor[q], TINY)]
                if len(high) >= k:  # a little less than the k-th highest
                    floor[q] = np.partition(high, len(high) - k)[len(high) - k] * (1 - SLACK)
        mine, values, out = np.zeros(len(self.weight), dtype=bool), np.zeros(len(self.weight)), []
        for q, (t, x) in enumerate(queries):
            i = np.nonzero(valid[q] >= max(floor[q], TINY))[0]
            if not len(i):
                out.append((np.empty(0), i))
                continue
            mine[t], values[t] = True, x * self.weight[t]
            spans = [slice(a, b) for a, b in zip(self.first[i].tolist(), (self.first[i] + self.size[i]).tolist(), strict=True)]
            terms = np.concatenate([self.terms[s] for s in spans])
            shared = np.nonzero(mine.take(terms))[0]
            counts = np.concatenate([self.counts[s] for s in spans])[shared]
            dots = values.take(terms[shared]) * counts
            of = np.searchsorted(np.cumsum(self.size[i]), shared, "right")
            cosines = np.round(np.bincount(of, dots, len(i)) / self.norm[i], 12)
            mine[t], values[t] = False, 0
            best = np.lexsort((self.tie[i], -cosines))[:k]
            out.append((cosines[best], self.tie[i][best]))
        return out


class ToxicityModel:
    """Fitted on (id, toxic, term hashes, counts) of examples; ``totals`` are the labelled rows of each label."""

    def __init__(self, examples: Iterable[tuple[int, int, np.ndarray, np.ndarray]], totals: tuple[int, int]):
        # all hashes and counts in a row: the driver holds them once
        rows, hashes, counts = [], [], []
        for i, y, h, c in examples:
            rows.append((i, y, zlib.crc32(h), zlib.crc32(c), len(h), len(rows)))
            hashes.append(h)
            counts.append(c.astype(np.uint16) if not len(c) or c.max() < 1 << 16 else c)
        rows.sort()
        hashes, counts = ([x[r[-1]] for r in rows] for x in (hashes, counts))
        sampled = [sum(r[1] == y for r in rows) for y in (0, 1)]
        self.usable, self.table, self._shared = min(sampled) > 0, None, None
        if not self.usable:
            return
        class_weight = [totals[y] / sampled[y] for y in (0, 1)]
        empty = [class_weight[y] * sum(r[1] == y and not r[4] for r in rows) for y in (0, 1)]
        self.empty = empty[1] / sum(empty) if sum(empty) else 0.0
        self.prior = totals[1] / sum(totals)
        n, held = len(rows), [r for r in rows if r[4]]
        self.ids = np.array([r[0] for r in held], dtype=np.int64)
        self.labels = np.array([r[1] for r in held], dtype=np.int32)
        self.weight = np.array(class_weight)[self.labels]
        size = np.array([r[4] for r in held], dtype=np.int64)
        counts = np.concatenate([np.empty(0, dtype=np.uint16), *counts])
        flat = np.concatenate([np.empty(0, dtype=np.uint64), *hashes])
        del hashes
        self.vocab = np.unique(flat)
        terms = np.searchsorted(self.vocab, flat).astype(np.int32)
        del flat
        # frequent terms first, so that what most texts look up lies close together
        order = np.argsort(-np.bincount(terms, minlength=len(self.vocab)), kind="stable").astype(np.int32)
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.vocab, terms = self.vocab[order], place[terms]
        toxic = np.repeat(self.labels.astype(bool), size)
        df = [np.bincount(terms[toxic == y], minlength=len(self.vocab)) for y in (False, True)]
        odds = np.log((df[1] + 0.5) / (sampled[1] + 1)) - np.log((df[0] + 0.5) / (sampled[0] + 1))
        sure = odds - np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
        factor = np.maximum(FLOOR, np.clip(sure / LOG_ODDS, 0, 1) ** 2)
        self.index = ExampleIndex(size, terms, counts, factor * (np.log((n + 1) / (df[0] + df[1] + 1)) + 1))
        self.slope, self.shift = 1.0, 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "_shared")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.table = self._shared = None

    def shared(self, spark: SparkSession):
        """The model as a broadcast, made once."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = counts * self.index.weight[terms]
        return terms, x / np.sqrt((x * x).sum())

    def vote(self, cosines: np.ndarray, near: np.ndarray) -> float:
        """Share of toxic neighbours weighted by cosine, sharply below the nearest, drawn to the prior where all are far."""
        if not len(near):
            return self.prior
        weight = self.weight[near]
        w = cosines * cosines * (cosines / cosines[0]) ** SHARPNESS * weight
        smooth = SMOOTHING * float(weight.mean())
        return float(((w * self.labels[near]).sum() + smooth * self.prior) / (w.sum() + smooth))

    def left_out_votes(self, examples: list[int]) -> list[float]:
        """The vote on each of these examples by all others."""
        self.index.ready()
        out, place = [], np.argsort(self.index.order)
        for a in range(0, len(examples), TEXTS):
            at = place[examples[a : a + TEXTS]]
            held = [slice(self.index.first[i], self.index.first[i] + self.index.size[i]) for i in at]
            got = self.index.search([self._unit(self.index.terms[h], self.index.counts[h]) for h in held], NEIGHBOURS, at.tolist())
            out += [self.vote(*near) for near in got]
        return out

    def calibrate(self, votes: list[float]) -> None:
        """Logistic fit of labels on leave-one-out votes, by Newton steps with a small ridge."""
        if not votes:
            return
        x, y = np.array([self._logit(v) for v in votes]), self.labels.astype(float)
        a = np.stack([x, np.ones_like(x)], axis=1)
        theta, w, ridge = np.array([1.0, 0.0]), self.weight / self.weight.mean(), 0.05 * len(votes)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            grad = a.T @ (w * (p - y)) + ridge * (theta - [1.0, 0.0])
            hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
            step = np.linalg.solve(hess, grad)
            theta = theta - step
            if np.abs(step).max() < 1e-9:
                break
        if theta[0] > 0.05:
            self.slope, self.shift = float(theta[0]), float(theta[1])

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def vectors(self, rows: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The known terms of each text, ascending, and their counts."""
        owner, h = term_hashes(rows)
        self.table = self.table or HashTable(self.vocab)
        at = self.table.find(h)
        known = at >= 0
        wide = np.int64(max(1, len(self.vocab)))
        key, n = np.unique(owner[known] * wide + at[known], return_counts=True)
        cut = np.searchsorted(key, np.arange(len(rows) + 1) * wide)
        terms = (key % wide).astype(np.int32)
        return [(terms[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def scores(self, rows: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the calibrated score, and the cosines and indices of the neighbours behind it."""
        none = np.empty(0), np.empty(0, dtype=np.int64)
        if not self.usable:
            yield from ((0.0, *none) for _ in rows)
            return
        for a in range(0, len(rows), TEXTS):
            found = self.vectors(rows[a : a + TEXTS])
            nearest = iter(self.index.search([self._unit(*tf) for tf in found if len(tf[0])], NEIGHBOURS))
            for tf in found:
                if not len(tf[0]):
                    yield self.empty, *none
                    continue
                cosines, near = next(nearest)
                z = self.slope * self._logit(self.vote(cosines, near)) + self.shift
                yield 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), cosines, near


def remainder(id_: Column) -> Column:
    """crc32 of an id as text, mod 4: 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: (id, y, term hashes, counts) of rows (id, y, text)."""
    for whole in batches:
        for batch in slices(whole, 2):
            got = [features(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["id", "y", "h", "c"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from labelled rows that aren't held out; of each label the ``per_label`` rows of lowest hash."""
    spark = docs.sparkSession
    ship(spark)
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y is not null").filter(remainder(F.col("id")) != 2)
        .groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    )
    count = {r.y: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = spark.createDataFrame([(r.id, r.y) for r in lowest(marked, "y", count, per_label)], "id long, y int")  # 2 * per_label rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")
    got = rows.transform(mapped, _features, "id long, y int, h binary, c binary").toLocalIterator()
    model = ToxicityModel(((r.id, r.y, np.frombuffer(r.h, dtype=np.uint64), np.frombuffer(r.c, dtype=np.int32)) for r in got), (count.get(0, 0), count.get(1, 0)))
    if model.usable:
        shared = model.shared(spark)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.left_out_votes(batch.column(0).to_pylist()), pa.float64())], names=["i", "vote"])

        n = len(model.ids)
        votes = spark.range(0, n, 1, max(1, min(-(-n // 500), spark.sparkContext.defaultParallelism))).transform(mapped, vote, "i long, vote double").collect()
        model.calibrate([r.vote for r in sorted(votes)])
    return model


def toxicity(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, score, predicted, evidence (array of doc_id, cosine, toxic of the neighbours)."""
    spark = docs.sparkSession
    ship(spark)
    shared, fitted = model.shared(spark), (getattr(model, "slope", 1.0), getattr(model, "shift", 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.slope, m.shift = fitted
        for whole in batches:
            for batch in slices(whole, 1):
                got = list(m.scores(texts(batch.column(1))))
                near = np.concatenate([g[2] for g in got]).astype(np.int64)
                ids, labels = (m.ids[near], m.labels[near]) if m.usable else (near, near.astype(np.int32))
                offsets = np.concatenate(([0], np.cumsum([len(g[2]) for g in got]))).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(ids), pa.array(np.concatenate([g[1] for g in got])), pa.array(labels)], names=["doc_id", "cosine", "toxic"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.transform(mapped, run, "id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared, fitted = model.shared(spark), (getattr(model, "slope", 1.0), getattr(model, "shift", 0.0))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.slope, m.shift = fitted
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array([s < threshold for s, _, _ in m.scores(texts(batch.column(at)))], pa.bool_()))

    return docs.transform(mapped, run, docs.schema)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")
