import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ROWS, awkward, empty

from quillstream.llm import common
from quillstream.llm import jaccard_join as J
from quillstream.llm.components import components, labels
from quillstream.llm.shingles import shingle_sets

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, pct):
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= pct * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rng, n):
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w[: len(w) - rng.randrange(4)]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [t for _ in range(5) for t in family(rng, 8)] + ["a b c", "A  b\tC", "a b", "", "common passage " * 20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, pct, block in ((4, 85, 4), (5, 80, 2048), (3, 30, 6)):  # few a block: several parts a group
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard_join(df, k, pct, block=block).collect()}
        want = brute(rows, k, pct)
        assert got == {i: (len(shingles(t, k)), want[i]) for i, t in rows}
        assert len(set(want.values())) < len(rows)


def test_rows_that_repeat_an_id_are_one_node(spark, monkeypatch):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (60, 80, 40))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (5, c + " more"), (5, ""), (6, a.upper()), (0, "x"), (7, c), (7, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (500_000, 0):  # ids broadcast, and joined
        monkeypatch.setattr(common, "FEW", few)
        got = {(r.doc_id, r.n_shingles): r.component_id for r in J.ngram_jaccard_join(df, 4, 85).collect()}
        want = brute(rows, 4, 85)
        assert got == {(i, len(shingles(t, 4))): want[i] for i, t in rows}
        assert {got[i, 57] for i in (1, 2, 6)} | {got[i, 77] for i in (2, 3)} == {1}


def test_two_near_families_give_as_many_links_as_sets(spark):
    """Families that pass no exact test with each other, and sets at the threshold: links stay fewer than sets."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for f in range(2):
        own = base[: 80 + 2 * f] + [f"f{f}_{i}" for i in range(20)]
        for _ in range(40):
            w = list(own)
            for _ in range(3):
                w[rng.randrange(100)] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 20):
        got = {r.doc_id: r.component_id for r in J.ngram_jaccard_join(df, 4, 85, block=block).collect()}
        assert got == brute(rows, 4, 85)


def test_all_links_between_different_sets(spark):
    rng = random.Random(12)
    texts = [t for _ in range(4) for t in family(rng, 8)] + ["a b c d", "A B c d", "x"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    first = [next(j for j, s in enumerate(sets) if s == x) for x in sets]
    want = {(a, b) for a in set(first) for b in set(first) if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    for block in (2048, 3):
        links, member = J.ngram_jaccard_links(df, 4, 85, block=block)
        got = [(r.a, r.b) for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        assert {r.doc_id: r.set_id for r in member.collect()} == dict(enumerate(first))


def test_keys_that_meet_over_batches():
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(i)) for k, i in zip(rng.integers(0, 60, 900), rng.integers(0, 300, 900), strict=True)} | {(7, i) for i in range(200)})
    rows = [r for r in rows for _ in range(1 + (r[1] % 3 == 0))]  # repeated rows are next to each other
    for size in (1, 3, 50, 5000):
        cut = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[a : a + size]], pa.int64()) for c in (0, 1)], names=["key", "id"]) for a in range(0, len(rows), size)]
        got, single = {}, set()
        for batch in J._gather(20)(iter(cut)):
            for r in batch.to_pylist():
                assert r["big"] or r["key"] not in single
                single.add(r["key"])
                got.setdefault((r["key"], r["big"]), set()).update(r["ids"])
        want = {}
        for k, i in rows:
            want.setdefault(k, set()).add(i)
        seen = {frozenset(v) for v in want.values() if len(v) > 1}
        assert {frozenset(v) for v in got.values()} == seen
        assert all(big == (len(v) > 20) for (_, big), v in got.items())


def test_awkward_rows(spark):
    got = J.op1_jaccard_join(awkward(spark)).collect()
    want = brute([(i, t) for i, t, *_ in ROWS if i is not None], 4, 85)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert J.op1_jaccard_join(empty(spark)).collect() == []


def test_bounds_are_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pool = rng.integers(0, 2**62, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(50, 400))) for _ in range(2))
        x, y = J.bitmap(a), J.bitmap(b)
        width = min(len(x), len(y))
        up = J.bounds(J.fold(x[None], width), np.array([len(a)]), J.fold(y[None], width), np.array([len(b)]))[0, 0]
        assert up >= len(np.intersect1d(a, b))


def test_sets_equal_python_sets():
    texts = ["Ab c\x0bd e f", "ab C d e f", "", " \n", "x", "x y", "é è ê ë", "É è ê ë", "a" * 5000 + " b c d"]
    got = shingle_sets([t.encode() for t in texts], 4)
    want = [shingles(t, 4) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (got[i].tolist() == got[j].tolist()) == (want[i] == want[j])


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, most):
    monkeypatch.setattr("quillstream.llm.components.ONE_TASK", most)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_labels_against_a_plain_search():
    rng = np.random.default_rng(7)
    for n, m in ((30, 12), (2000, 1900), (500, 3000)):
        u, v = rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3
        root = {x: x for x in [*u.tolist(), *v.tolist()]}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        node, component = labels(u, v)
        assert dict(zip(node.tolist(), component.tolist(), strict=True)) == {x: find(x) for x in root}
    chain = np.arange(200_000)
    assert (labels(chain[:-1], chain[1:])[1] == 0).all()
