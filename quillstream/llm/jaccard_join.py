"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

1.  One pass hashes every text's word shingles to a sorted set, and yields its size, a 128-bit digest, and a
    count of the corpus's shingles by hash bucket.  Texts with one digest have one set; the smallest id stands
    for them from here on.
2.  Shingles are put in one order for all texts: those of buckets that are far fuller than the mean (shared
    passages, families of copies) last, else by hash.  Two sets that reach the threshold share one of their
    first n - ceil(t n) + 1 elements, so each set is filed under these keys.  The order affects cost, never
    results.  One shuffle of narrow (key, id) rows gathers the keys of ordinary shingles and drops those with
    one set; keys of full buckets are counted by partial aggregates first, so none is gathered row by row.
    Of keys that file the same sets one is kept.
3.  Sets that meet under a key are compared in tiles: sorted by size, blocks against the window of sizes
    within the threshold, on bitmaps of the hashes.  With I common bits, at least bits(A) - I elements of A
    are not in B, which bounds the overlap from above.  A key yields a spanning forest of the pairs whose
    bound reaches the threshold, at most one pair per set; the components of all forests are the clusters
    of candidates, so any two sets that link are in one cluster.
4.  Each text of a cluster travels once, to its cluster.  There pairs are tried in the same tiles, with wider
    bitmaps, and those whose bound reaches the threshold are verified by intersecting the sorted arrays,
    unless verified links join their sets already.  So a cluster of m sets yields fewer than m links, and the
    components of the links are those of all links.

A key or cluster beyond a block (of sets, and of elements) is dealt to parts.  Parts are solved alone first;
then one set stands for each component a group holds, and these are solved, until nothing joins; what is
still apart is compared by a grid in which the sets of the group's largest component stay in their part and
only the others are sent to each part.  All steps over groups hold one group at a time.

Defined results: texts without words have an empty set and are linked with nothing; null ids take part in no
link and have a null component; rows that repeat an id are one node, which has the links of all its texts;
empty tables give empty results; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import few, mapped, materialize, ship, slices
from quillstream.llm.components import components
from quillstream.llm.shingles import mix, shingle_sets

#: Buckets of the corpus's shingle counts.
BUCKETS = 1 << 17
#: Sets, and elements of sets, of a group that are compared in one part.
BLOCK, BLOCK_ELEMENTS = 2048, 1 << 21
#: Entries of a comparison matrix held at once, in 64-bit words.
TILE = 1 << 20
#: Bitmaps have at least so many bits an element, and up to twice as many: while filing, and in clusters.
NARROW, WIDE = 2, 4
_PAIR = "a long, b long"
_SIGN = np.uint64(1 << 63)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _digests(k: int):
    """Map function: (id, n, d1, d2) a text, and (bucket, n) for a task's shingles."""
    names = ["id", "n", "d1", "d2", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(_bytes(batch.column(1)), k)
                d = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]).reshape(-1, 2)
                counts += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, _i64(d[:, 0]), _i64(d[:, 1]), pa.nulls(len(sets), pa.int32())], names=names)
        used = np.nonzero(counts)[0]
        null = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([null, pa.array(counts[used]), null, null, pa.array(used, pa.int32())], names=names)

    return run


def ordered(sets: list[np.ndarray], hot: np.ndarray) -> list[np.ndarray]:
    """Sets as 63-bit hashes in the common order: the top bit marks shingles of full buckets."""
    return [np.sort((s >> np.uint64(1)) | (hot[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63))) for s in sets]


def prefix_size(n: int, pct: int) -> int:
    return n - -(-n * pct // 100) + 1


def bitmap(s: np.ndarray, per_element: int = NARROW) -> np.ndarray:
    """A bit per hash, in a power of two of bits: ``per_element`` to twice as many an element, 64 at least."""
    width = 1 << max(6, int(per_element * len(s) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _prefixes(k: int, pct: int, hot: np.ndarray):
    """Map function: (id, n, keys in order, bitmap); keys of full buckets are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = ordered(shingle_sets(_bytes(batch.column(1)), k), hot)
                keys = [s[: prefix_size(len(s), pct)] if len(s) else s for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _i64(np.concatenate(keys)))
                maps = pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), lists, maps], names=["id", "n", "keys", "bits"])

    return run


def _gather(block: int):
    """Map function over rows (key, id) sorted by both: (key, ids, h1, h2, big) of the keys with two ids at least.

    A key with more than ``block`` ids gives several rows, which are marked as big.
    """
    names = ["key", "ids", "h1", "h2", "big"]

    def rows(key: np.ndarray, ids: np.ndarray, big: bool) -> Iterator[pa.RecordBatch]:
        """Of whole keys those with two ids to ``block`` (then also larger ones), or of a big key a piece."""
        if not len(key):
            return
        start = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        size = np.diff(np.append(start, len(key)))
        over = (size > block) | big
        for some, is_big in ((~over & (size > 1), False), (over, True)):
            if not some.any():
                continue
            n, mine = size[some], np.repeat(some, size)
            offsets = np.concatenate(([0], np.cumsum(n)))
            values = ids[mine].view(np.uint64)
            h = [np.add.reduceat(mix(values ^ np.uint64(seed)), offsets[:-1]).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D)]
            first = np.unique(np.stack(h, axis=1), axis=0, return_index=True)[1] if not is_big else np.arange(len(n))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[mine])).take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(key[start[some]][first]), lists, pa.array(h[0][first]), pa.array(h[1][first]), pa.array(np.full(len(first), is_big))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        big = None  # the key that is cut
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            ids = np.concatenate((ids, batch.column(1).to_numpy()))
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
            key, ids = key[fresh], ids[fresh]
            if big is not None:
                end = int(np.searchsorted(key, big, "right"))
                if end:
                    yield from rows(key[:end], ids[:end], True)
                    # the last id stays known, so that a repeated row is not taken for another
                    key, ids = (key[end - 1 :], ids[end - 1 :]) if end == len(key) else (key[end:], ids[end:])
                if len(key) and key[-1] == big:
                    continue
                big = None
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from rows(key[:end], ids[:end], False)
            key, ids = key[end:], ids[end:]
            if len(key) > block:
                big = int(key[-1])
                yield from rows(key, ids, True)
                key, ids = key[-1:], ids[-1:]
        if big is None:
            yield from rows(key, ids, False)

    return run


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded to a smaller width."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def bounds(a_bits, a_n, b_bits, b_n) -> np.ndarray:
    """Upper bounds of the overlaps of rows of a with rows of b."""
    common = np.bitwise_count(a_bits[:, None, :] & b_bits[None, :, :]).sum(axis=2, dtype=np.int64)
    spare_a = a_n - np.bitwise_count(a_bits).sum(axis=1, dtype=np.int64)
    spare_b = b_n - np.bitwise_count(b_bits).sum(axis=1, dtype=np.int64)
    return common + np.minimum(spare_a[:, None], spare_b[None, :])


def needed(a_n, b_n, pct: int):
    """The least overlap with which two sizes reach the threshold."""
    return -(-(a_n + b_n) * pct // (100 + pct))


def exact_test(sets: list[np.ndarray], n: np.ndarray, pct: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """(i, js) -> which of sets js reach the threshold with set i, by intersecting sorted arrays coded by rank."""
    at = np.concatenate(([0], np.cumsum(n)))
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), dtype=bool)

    def test(i: int, js: np.ndarray) -> np.ndarray:
        own = ranks[at[i] : at[i + 1]]
        mine[own] = True
        if len(js) * 4 > len(n):
            upto = np.concatenate(([0], np.cumsum(mine[ranks])))
            both = upto[at[js + 1]] - upto[at[js]]
        else:
            both = np.array([np.count_nonzero(mine[ranks[at[j] : at[j + 1]]]) for j in js])
        mine[own] = False
        return 100 * both >= pct * (n[i] + n[js] - both)

    return test


class Group:
    """Sets that meet, by size: ids, sizes, labels, sides, bitmaps in classes of one width, and the sets where given."""

    def __init__(self, ids, sizes, labels, sides, bits: list[np.ndarray], sets: list[np.ndarray] | None = None):
        order = np.lexsort((ids, sizes))
        self.ids, self.n, self.labels, self.sides = ids[order], sizes[order], labels[order], sides[order]
        self.sets = [sets[i] for i in order] if sets else None
        width = np.array([len(bits[i]) for i in order])
        self.classes = []  # (words, first, end): sizes ascend, so widths do
        for w in np.unique(width):
            a, b = np.searchsorted(width, w), np.searchsorted(width, w, "right")
            self.classes.append((int(w), int(a), int(b), np.stack([bits[i] for i in order[a:b]])))

    def tiles(self, pct: int):
        """(i, j, fit): index arrays and the matrix of pairs i < j whose bound reaches the threshold."""
        for c, (w, a, b, rows) in enumerate(self.classes):
            for _, a2, b2, rows2 in self.classes[c:]:
                if self.n[a2] * pct > self.n[b - 1] * 100:
                    break
                others = fold(rows2, w)
                at = a
                while at < b:
                    # the window of sizes that any row of this block can reach
                    first = max(at, a2)
                    step = max(1, min(256, TILE // max(1, w * (b2 - first))))
                    end = min(b, at + step)
                    last = min(b2, int(np.searchsorted(self.n, self.n[end - 1] * 100 // pct, "right")))
                    if last > first:
                        wide = max(1, TILE // (w * (end - at)))
                        for lo in range(first, last, wide):
                            hi = min(last, lo + wide)
                            i, j = np.arange(at, end), np.arange(lo, hi)
                            fit = bounds(rows[at - a : end - a], self.n[i], others[lo - a2 : hi - a2], self.n[j]) >= needed(self.n[i][:, None], self.n[j][None, :], pct)
                            fit &= i[:, None] < j[None, :]
                            if fit.any():
                                yield i, j, fit
                    at = end

    def spanning(self, pct: int, across: bool) -> list[tuple[int, int]]:
        """Pairs (ids) that fit, exactly where sets are given, and join different labels; none that joins what is joined.

        ``across``: only pairs of different sides are tried.
        """
        root = np.unique(self.labels, return_inverse=True)[1]
        test = exact_test(self.sets, self.n, pct) if self.sets else None
        out: list[tuple[int, int]] = []
        for i, j, fit in self.tiles(pct):
            for r in np.nonzero(fit.any(axis=1))[0]:
                me = i[r]
                js = j[fit[r]]
                js = js[root[js] != root[me]]
                if across:
                    js = js[self.sides[js] != self.sides[me]]
                if test and len(js):
                    js = js[test(me, js)]
                if len(js):
                    joined, first = np.unique(root[js], return_index=True)
                    out += [(int(self.ids[me]), int(self.ids[x])) for x in js[first]]
                    root[np.isin(root, joined)] = root[me]
        return out


    def links(self, pct: int, across: bool) -> list[tuple[int, int]]:
        """All pairs of different ids, the smaller first, that reach the threshold; ``across`` as above."""
        test = exact_test(self.sets, self.n, pct)
        out: list[tuple[int, int]] = []
        for i, j, fit in self.tiles(pct):
            for r in np.nonzero(fit.any(axis=1))[0]:
                me = i[r]
                js = j[fit[r]]
                js = js[self.ids[js] != self.ids[me]]
                if across:
                    js = js[self.sides[js] != self.sides[me]]
                js = js[test(me, js)] if len(js) else js
                a, b = np.minimum(self.ids[js], self.ids[me]), np.maximum(self.ids[js], self.ids[me])
                out += zip(a.tolist(), b.tolist(), strict=True)
        return out


def _solve(pct: int, across: bool, k: int | None, every: bool = False):
    """Map function over rows (gid, p, q, side, id, label, n, data) sorted by group: the spanning pairs (a, b) of each group,
    or ``every`` link.

    ``data`` is a bitmap, or, with ``k``, a text of which the set is made.  A group is the only thing that is held.
    """

    def group(ids, sides, labels, sizes, data) -> list[tuple[int, int]]:
        if len(set(labels)) == 1 or (across and len(set(sides)) == 1):
            return []
        sets = None
        if k:
            sets = shingle_sets(data, k)
            some = [i for i, s in enumerate(sets) if len(s)]  # an id's other texts may be empty
            ids, sides, labels, sets = ([x[i] for i in some] for x in (ids, sides, labels, sets))
            if not sets:
                return []
            sizes = [len(s) for s in sets]
            bits = [bitmap(s, WIDE) for s in sets]
        else:
            bits = [np.frombuffer(x, dtype=np.uint64) for x in data]
        met = Group(np.array(ids), np.array(sizes), np.array(labels), np.array(sides), bits, sets)
        return met.links(pct, across) if every else met.spanning(pct, across)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, None
        found: list[tuple[int, int]] = []
        for whole in batches:
            for batch in slices(whole, 7):
                cols = [c.to_pylist() for c in batch.columns[:7]] + [_bytes(batch.column(7))]
                keys = list(zip(*cols[:3], strict=True))
                rows = (cols[4], cols[3], cols[5], cols[6], cols[7])
                starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for a, b in zip(starts, starts[1:], strict=False):
                    if keys[a] == held_key:
                        for h, c in zip(held, rows, strict=True):
                            h += c[a:b]
                        continue
                    if held:
                        found += group(*held)
                    held_key, held = keys[a], [c[a:b] for c in rows]
                if len(found) > 20_000:
                    yield _pairs(found)
                    found = []
        if held:
            found += group(*held)
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def _parted(members: DataFrame, block: int, elements: int) -> DataFrame:
    """(gid, id, n) with ``parts``, as many as its sets and elements ask for, and the ``part`` of each row.

    Only groups of several parts are looked up, so members of a large group aren't gathered for it.
    """
    members = materialize(members, "members", True)
    size = members.groupBy("gid").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    parts = F.greatest(F.ceil(F.col("rows") / F.lit(block)), F.ceil(F.col("elements") / F.lit(elements)), F.lit(1)).cast("int")
    large = materialize(size.select("gid", parts.alias("parts")).filter("parts > 1"), "large", True)
    out = members.join(F.broadcast(large) if few(large) is not None else large, "gid", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return out.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def spanning_pairs(members: DataFrame, attach: Callable[[DataFrame], DataFrame], pct: int, tag: str, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) whose components are those of all fitting pairs of two members of a group, without cycles in a group.

    ``members`` has (gid, id, n), ``attach`` adds n and data to rows with an id.
    """

    def solved(rows: DataFrame, across: bool, name: str) -> DataFrame:
        """rows: gid, p, q, side, id, label."""
        dealt = attach(rows).select("gid", "p", "q", "side", "id", "label", "n", "data")
        return materialize(dealt.repartition("gid", "p", "q").sortWithinPartitions("gid", "p", "q").transform(mapped, _solve(pct, across, k), _PAIR), f"{tag}-{name}")

    zero = F.lit(0)
    most_elements = BLOCK_ELEMENTS * (1 if k else 64 // (2 * NARROW))  # as many bytes of sets or of bitmaps
    parted = _parted(members, block, most_elements)
    pairs = solved(parted.select("gid", F.col("part").alias("p"), zero.alias("q"), zero.alias("side"), "id", F.col("id").alias("label")), False, "parts")
    several = parted.filter("parts > 1").select("gid", "id", "n")  # of the written members and large groups
    if several.isEmpty():
        return pairs

    def labelled(pairs: DataFrame) -> DataFrame:
        """(gid, id, n, label) of the groups that hold several labels."""
        label = components(pairs).select(F.col("node").alias("id"), "component")
        rows = materialize(several.join(label, "id", "left").select("gid", "id", "n", F.coalesce("component", "id").alias("label")), f"{tag}-labels", True)
        mixed = rows.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("gid")
        return rows.join(mixed, "gid")

    while True:  # one set for each label, until nothing joins
        apart = labelled(pairs)
        stand = apart.groupBy("gid", "label").agg(F.min_by("id", F.struct("n", "id")).alias("id"), F.min("n").alias("n"))
        stand = _parted(stand, block, most_elements).select("gid", F.col("part").alias("p"), zero.alias("q"), zero.alias("side"), "id", "label")
        more = solved(stand, False, "stand")
        if more.isEmpty():
            break
        pairs = materialize(pairs.unionByName(more), f"{tag}-pairs", True)
    # the largest label of a group stays in its parts; the others also go to all parts, in blocks of their own
    most = apart.groupBy("gid", "label").count().groupBy("gid").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    home = _parted(apart.select("gid", "id", "n", "label"), block, most_elements)
    minor = _parted(apart.join(most, "gid").filter("label <> most").select("gid", "id", "n", "label"), block, most_elements)
    grid = minor.select("gid", F.col("parts").alias("qs")).distinct()
    rows = home.join(grid, "gid").select("gid", F.col("part").alias("p"), F.explode(F.sequence(zero, F.col("qs") - 1)).alias("q"), zero.alias("side"), "id", "label").unionByName(
        minor.join(home.select("gid", F.col("parts").alias("ps")).distinct(), "gid")
        .select("gid", F.explode(F.sequence(zero, F.col("ps") - 1)).alias("p"), F.col("part").alias("q"), F.lit(1).alias("side"), "id", "label")
    )
    return materialize(pairs.unionByName(solved(rows, True, "grid")), f"{tag}-pairs")


def filed_groups(keys: DataFrame, block: int) -> DataFrame:
    """(gid, id): of the keys (key, id) with two ids at least, one of those that hold the same ids."""
    ordinary = keys.filter("key >= 0").repartition("key").sortWithinPartitions("key", "id")
    met = materialize(ordinary.transform(mapped, _gather(block), "key long, ids array<long>, h1 long, h2 long, big boolean"), "met")
    small = met.filter("not big").groupBy("h1", "h2").agg(F.min_by("ids", "key").alias("ids"), F.min("key").alias("gid"))
    # keys of full buckets, and those beyond a block: counted before rows are gathered
    full = keys.filter("key < 0")
    live = full.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    large = full.join(live, "key").select("key", "id").unionByName(met.filter("big").select("key", F.explode("ids").alias("id"))).distinct()
    large = materialize(large, "large", True)
    seen = large.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.sum(F.xxhash64(F.lit("s"), "id").cast("decimal(38,0)")).alias("h2")
    )
    one = seen.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    return small.select("gid", F.explode("ids").alias("id")).unionByName(large.join(one, "key").select(F.col("key").alias("gid"), "id"))


def ngram_jaccard_join(docs: DataFrame, words: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles, set_id (the smallest id with the same set), component_id (the smallest id reachable).

    Two texts link when 100 * intersection >= pct * union of their distinct ``words``-word shingles.
    """
    return _join(docs, words, pct, id_col, text_col, block)[0]


def ngram_jaccard_links(docs: DataFrame, words: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), a < b, of all different sets that link, by the smallest ids that hold them, and the membership
    (id_col, n_shingles, set_id, component_id).

    A family of m near copies has up to m (m - 1) / 2 links, all of which are listed; the join above lists none.
    """
    member, _, clusters, with_text, k = _join(docs, words, pct, id_col, text_col, block)
    parted = _parted(clusters, block, BLOCK_ELEMENTS)
    zero = F.lit(0)
    dealt = parted.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))  # each part meets each
    rows = dealt.select("gid", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.col("part").alias("side"), "id", F.col("id").alias("label"))

    def solved(some: DataFrame, across: bool) -> DataFrame:
        ready = with_text(some).select("gid", "p", "q", "side", "id", "label", "n", "data")
        return ready.repartition("gid", "p", "q").sortWithinPartitions("gid", "p", "q").transform(mapped, _solve(pct, across, k, True), _PAIR)

    links = solved(rows.filter("p = q"), False).unionByName(solved(rows.filter("p < q"), True)).distinct()
    return materialize(links, "links"), member


def _join(docs: DataFrame, words: int, pct: int, id_col: str, text_col: str, block: int) -> tuple:
    """The join's result, and what it was made from: candidate pairs, clusters, texts by id, the shingle size."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    passed = materialize(rows.transform(mapped, _digests(words), "id long, n long, d1 long, d2 long, bucket int"), "digests")
    texts = passed.filter("bucket is null").drop("bucket")
    buckets = passed.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    mean = (buckets.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    hot = np.zeros(BUCKETS, dtype=bool)  # as large for any corpus
    hot[[r.bucket for r in buckets.filter(F.col("n") > mean + 8 * mean**0.5 + 32).select("bucket").collect()]] = True
    known = texts.filter("n > 0 and id is not null")
    sets = materialize(known.groupBy("d1", "d2").agg(F.min("id").alias("set_id"), F.first("n").alias("n")), "sets", True)
    stands = sets.select(F.col("set_id").alias("id")).distinct()

    # copies of sets that a smaller id stands for are not filed
    copies = few(materialize(known.select("id").distinct().join(stands, "id", "left_anti"), "copies", True))
    firsts = rows.filter("id is not null")
    firsts = firsts.join(F.broadcast(copies), "id", "left_anti") if copies is not None else firsts
    filed = firsts.transform(mapped, _prefixes(words, pct, hot), "id long, n long, keys array<long>, bits binary").filter("n > 0")
    filed = materialize(filed if copies is not None else filed.join(stands, "id", "left_semi"), "filed")

    size = filed.groupBy("id").agg(F.max("n").alias("n"))
    groups = filed_groups(filed.select(F.explode("keys").alias("key"), "id"), block)
    bitmaps = filed.select("id", "n", F.col("bits").alias("data"))
    near = spanning_pairs(groups.join(size, "id"), lambda r: r.join(bitmaps, "id"), pct, "near", block=block)

    clusters = components(near).select(F.col("component").alias("gid"), F.col("node").alias("id")).join(size, "id")

    def with_text(r: DataFrame) -> DataFrame:
        small = few(materialize(r, "tried", True))
        return firsts.join(F.broadcast(small) if small is not None else r, "id").withColumn("n", F.lit(0)).withColumnRenamed("text", "data")

    links = spanning_pairs(clusters, with_text, pct, "links", k=words, block=block)
    # sets that one id holds are one node
    member = texts.join(sets.select("d1", "d2", "set_id"), ["d1", "d2"], "left").withColumn("set_id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set_id")).otherwise(F.col("id")))
    held = member.filter("n > 0 and id is not null").groupBy("id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("id", "lo")
    same = held.join(member.select("id", "set_id"), "id").filter("lo < set_id").select(F.col("lo").alias("a"), F.col("set_id").alias("b"))
    joined = components(links.unionByName(same))

    out = member.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", F.coalesce("component", "set_id").alias("component_id")
    )
    return out, near, clusters, with_text, words


def op1_jaccard_join(docs: DataFrame) -> DataFrame:
    return ngram_jaccard_join(docs, words=4, pct=85).select("doc_id", "n_shingles", "component_id")
