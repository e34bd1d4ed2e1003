import pickle
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import ROWS, awkward, empty
from pyspark.sql import functions as F

from quillstream.llm import bpe as B
from quillstream.llm import common
from quillstream.llm import langid as L
from quillstream.llm import mixing as M
from quillstream.llm import toxicity as T
from quillstream.llm.common import lowest

ALPHABETS = {"aa": "abcde", "bb": "cdefg", "cc": "ßéüxy"}
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i, words(rng, ALPHABETS[lang], 40), lang, "s", 1))
    return spark.createDataFrame(rows, DOC)


def test_language_of_held_out_texts(spark):
    df = corpus(spark)
    got = L.op8_language_id(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 160
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_frequencies_and_features_against_plain_counts():
    rng = random.Random(5)
    rows = [words(rng, ALPHABETS[rng.choice(list(ALPHABETS))], 8) + rng.choice(["", "!  12\n", " Ä-b "]) for _ in range(40)] + ["", "123"]

    def grams(text):
        clean = " " + re.sub(r"[^a-zßàáäéüxy]+", " ", text.lower()).strip() + " " if re.search("[a-zßàáäéü]", text.lower()) else ""
        if clean and not text.lower()[-1].isalpha():
            pass  # what follows the last letter is one blank
        elif clean:
            clean = clean[:-1]
        return Counter(clean[i : i + n] for n in L.SIZES for i in range(len(clean) - n + 1))

    names = {}
    df = np.zeros(L.BUCKETS, dtype=np.int64)
    for text in rows:
        want, got = grams(text), dict(zip(*(x.tolist() for x in L.features(text)), strict=True))
        by_bucket = Counter()
        for g, n in want.items():
            if g not in names:
                names[g] = int(np.nonzero(_only(g))[0][0])
            by_bucket[names[g]] += n
        assert got == dict(by_bucket)
        df += np.bincount(list(by_bucket), minlength=L.BUCKETS)
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
    out = {r["bucket"]: r["n"] for b in L._frequencies(iter([batch])) for r in b.to_pylist()}
    assert out.pop(-1) == len(rows) and out == {int(i): int(df[i]) for i in np.nonzero(df)[0]}


def _only(gram):
    """The bucket of one n-gram: the counts of its code points less those of its shorter n-grams."""
    codes = np.array([ord(c) for c in gram], dtype=np.uint32)
    inner = sum((_only(gram[i : i + n]) for n in L.SIZES if n < len(gram) for i in range(len(gram) - n + 1)), np.zeros(L.BUCKETS, dtype=np.int64))
    return L.counts(codes) - inner


def test_training_against_a_plain_loop():
    """Follow the regularised leader, one coordinate at a time."""
    rng = random.Random(6)
    rows = [(lang, *L.features(words(rng, ALPHABETS[lang], 5))) for lang in ALPHABETS for _ in range(12)]
    df = np.bincount(np.concatenate([i for _, i, _ in rows]), minlength=L.BUCKETS)
    model = L.LanguageModel(rows, df, len(rows))
    langs, draw = sorted(ALPHABETS), np.random.default_rng(7)
    feats = []
    for lang, idx, count in rows:
        x = {int(i): (1 + np.log(c)) * (np.log((len(rows) + 1) / (df[i] + 1)) + 1) for i, c in zip(idx, count, strict=True)}
        norm = sum(v * v for v in x.values()) ** 0.5
        feats.append(({i: v / norm for i, v in x.items()}, langs.index(lang)))
    train = draw.permutation(len(feats))[len(feats) // 5 :]
    z, n = Counter(), Counter()

    def weight(i, y):
        if abs(z[i, y]) <= L.L1:
            return 0.0
        return -(z[i, y] - np.sign(z[i, y]) * L.L1) / ((L.BETA + n[i, y] ** 0.5) / L.ALPHA + L.L2)

    for _ in range(L.EPOCHS):
        for r in draw.permutation(train):
            x, y = feats[r]
            w = {(i, c): weight(i, c) for i in x for c in range(len(langs))}
            score = [sum(v * w[i, c] for i, v in x.items()) for c in range(len(langs))]
            e = np.exp(np.array(score) - max(score))
            p = e / e.sum()
            for i, v in x.items():
                for c in range(len(langs)):
                    g = v * (p[c] - (c == y))
                    sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / L.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    got = {(i, c): model.weights[i, c] for i, c in zip(*np.nonzero(model.weights), strict=True)}
    want = {k: weight(*k) for k in z if weight(*k)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_jobs_of_a_fit_do_not_depend_on_languages(spark):
    rng = random.Random(7)
    counted = []
    for n in (2, 12):
        rows = [(i, words(rng, "abcdefgh", 6), f"l{i % n}", "s", 1) for i in range(120)]
        df = spark.createDataFrame(rows, DOC)
        spark.sparkContext.setJobGroup(f"fit{n}", "")
        model = L.fit(df)
        counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{n}")))
        assert len(model.languages) == n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted[0] == counted[1]


def test_lowest_hashes_of_a_key(spark):
    """Ids of one key repeat so often that a bound on hashes leaves too few of them."""
    df = spark.range(5000).select((F.col("id") % 4000).alias("id"), F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("k"))
    few = spark.createDataFrame([(i % 2, "two") for i in range(4000)], "id long, k string")
    for some in (df, df.unionByName(few)):
        rows = some.withColumn("h", F.xxhash64("id")).collect()
        counts = Counter(r.k for r in rows)
        got = sorted((r.k, r.id) for r in lowest(some, "k", counts, 100))
        assert got == sorted((k, r.id) for k in counts for r in sorted((r for r in rows if r.k == k), key=lambda r: (r.h, r.id))[:100])
    assert lowest(df.limit(0), "k", {}, 5) == []


def test_language_awkward(spark):
    got = {(r.doc_id, r.lang_pred) for r in L.op8_language_id(awkward(spark)).collect()}
    assert {(3, "und"), (4, "und"), (7, "und"), (11, "und")} <= got
    assert L.op8_language_id(empty(spark)).collect() == []
    no_labels = awkward(spark).filter("doc_id = 12").withColumn("lang", F.lit(None).cast("string"))
    assert [r.lang_pred for r in L.op8_language_id(no_labels).collect()] == ["und"]


def test_index_is_exact(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 9, (300, 200)) * (rng.random((300, 200)) < 0.1)
    counts[200:, :100] = 0  # examples of two kinds
    counts[:, 0] = counts[:, 0].clip(1)
    counts[50] = counts[20]  # a tie
    weight = rng.random(200) + 0.1
    dense = counts * weight
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(np.nonzero(c)[0].astype(np.int32), c[c > 0].astype(np.int32)) for c in counts]
    index = T.ExampleIndex(np.array([len(t) for t, _ in rows]), *(np.concatenate(x) for x in zip(*rows, strict=True)), weight)
    index = pickle.loads(pickle.dumps(index))
    for skip in (None, np.argsort(index.order).tolist()):
        got = index.search([(t, dense[i, t]) for i, (t, _) in enumerate(rows)], 7, skip)
        for i, (cosines, near) in enumerate(got):
            scores = np.round(dense @ dense[i], 12)
            if skip:
                scores[i] = 0
            want = sorted(((s, j) for j, s in enumerate(scores) if s > 0), key=lambda e: (-e[0], e[1]))[:7]
            assert np.allclose(cosines, [s for s, _ in want], atol=1e-11)
            assert near.tolist() == [j for _, j in want]


def labelled(spark, n=600):
    rng = random.Random(9)
    bad = ["idiota", "morono", "scumish", "trashy"]
    rows, labels = [], []
    for i in range(n):
        w = words(rng, "abcdefghij", 30).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    truth = {r[0]: any(b in r[1].split() for b in bad) for r in rows}
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_toxicity_of_held_out_texts(spark):
    docs, labels, truth = labelled(spark)
    got = T.op9_toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and len(held) > 80
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) > 0.97
    model = T.fit(docs, labels)
    near = T.toxicity(docs, model).filter("predicted = 1").first().evidence
    assert near and near[0].cosine >= near[-1].cosine and near[0].toxic == 1
    kept = {r.doc_id for r in T.without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 1, 1), (5, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.op9_toxicity(awkward(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in T.op9_toxicity(awkward(spark), labels.limit(0)).collect()] == [0.0] * len(ROWS)
    assert T.op9_toxicity(empty(spark), labels).collect() == []
    assert T.without_toxic(awkward(spark), T.fit(awkward(spark), labels.limit(0))).count() == len(ROWS)


def test_copies_of_toxic_texts_with_rare_words(spark):
    """Each of these texts shares no word with any other example; all of them are examples, and so their copies are found."""
    docs, labels, _ = labelled(spark)
    rare = [(i, " ".join(f"{i * 30 + j:x}z" for j in range(30)), "en", "s", 1) for i in range(1000, 1040)]
    copies = [(r[0] + 1000, *r[1:]) for r in rare]
    docs = docs.union(spark.createDataFrame(rare + copies, DOC))
    labels = labels.union(spark.createDataFrame([(r[0], 1, 1) for r in rare], "doc_id long, quality int, toxic int"))
    used = {r.doc_id for r in docs.filter(T.remainder(docs.doc_id) != 2).collect()}
    got = {r.doc_id: r.predicted for r in T.op9_toxicity(docs, labels).collect()}
    wanted = [r[0] + 1000 for r in rare if r[0] in used]
    assert len(wanted) > 15 and all(got[i] for i in wanted)


def test_terms_are_words_and_their_prefixes():
    rows = ["Abcdefg abcd, x_y ÀÉ 12", "", "ab" * 400 + " abcdefh", "ÉTÉ été\n中文 İz", "abcd abcd abcd*"]
    owner, h = T.term_hashes(rows)
    name = {}
    for i, text in enumerate(rows):
        want = Counter()
        for w in re.findall(r"[^\W_]+", text):
            w = "".join(c.lower()[0] for c in w)
            want.update([w, *(f"{w[:n]}*" for n in T.PREFIXES if len(w) >= n)])
        got = Counter(h[owner == i].tolist())
        assert sorted(got.values()) == sorted(want.values())
        single = T.features(text)
        assert dict(zip(single[0].tolist(), single[1].tolist(), strict=True)) == got
        for w in set(want):
            alone = T.term_hashes([w.rstrip("*")])[1]
            mine = alone[[1 + [n for n in T.PREFIXES if n <= len(w) - 1].index(len(w) - 1)]] if w.endswith("*") else alone[:1]
            assert got[int(mine[0])] == want[w] and name.setdefault(int(mine[0]), w) == w


def test_nearest_examples_against_brute_force(monkeypatch):
    rng = random.Random(12)
    examples = [(i, words(rng, "abcd" if i % 3 else "wxyz", rng.randrange(1, 30)), int(rng.random() < 0.3)) for i in range(300)]
    for block in (64, 8):  # with 8, most blocks are left out by their bounds
        monkeypatch.setattr(T, "BLOCK", block)
        model = T.ToxicityModel([(i, y, *T.features(t)) for i, t, y in examples], (700, 90))
        unit = lambda text: dict(zip(*(x.tolist() for x in model._unit(*model.vectors([text])[0])), strict=True))
        vectors = [unit(t) for _, t, _ in examples]
        asked = [words(rng, "abcde", 12) for _ in range(80)] + [t for _, t, _ in examples[:20]]
        for text, (_, cosines, near) in zip(asked, model.scores(asked), strict=True):
            q = unit(text)
            exact = [sum(x * v.get(t, 0) for t, x in q.items()) for v in vectors]
            want = sorted((-c for c in exact if c > 0))[: T.NEIGHBOURS]
            assert np.allclose(cosines, [-c for c in want], atol=1e-8)
            assert np.allclose([exact[int(model.ids[i])] for i in near], cosines, atol=1e-8)
        plain = [sorted(((-sum(x * w.get(t, 0) for t, x in v.items()), j) for j, w in enumerate(vectors) if j != i))[: T.NEIGHBOURS] for i, v in enumerate(vectors[:40])]
        for vote, near in zip(model.left_out_votes(list(range(40))), plain, strict=True):
            near = [(-c, j) for c, j in near if c < 0]
            w = np.array([c * c * (c / near[0][0]) ** T.SHARPNESS * model.weight[j] for c, j in near])
            smooth = T.SMOOTHING * np.mean([model.weight[j] for _, j in near])
            share = (sum(x * examples[j][2] for x, (_, j) in zip(w, near, strict=True)) + smooth * model.prior) / (w.sum() + smooth)
            assert abs(vote - share) < 0.02  # cosines that tie may be others


def totals(rows):
    p = np.array([r.posterior for r in rows if r.posterior])
    return (np.array([r.rate * r.tokens for r in rows if r.posterior])[:, None] * p).sum(axis=0)


def test_mixing_meets_targets(spark):
    df = corpus(spark)
    rows = M.mixing_rates(df, df, targets={"aa": 1, "bb": 1, "cc": 2}).collect()
    t = totals(rows)
    assert np.allclose(t / t.sum(), [0.25, 0.25, 0.5], atol=1e-4) and min(r.rate for r in rows) >= 0
    assert np.isclose(t.sum(), sum(r.tokens for r in rows), rtol=1e-4)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)
    up = M.mixing_rates(df, df, min_rate=1.0).collect()
    assert min(r.rate for r in up) >= 1.0 and min(r.copies for r in up) >= 1


def test_mixing_hits_the_bound_when_a_domain_is_unwanted(spark):
    df = corpus(spark)
    rows = M.mixing_rates(df, df, targets={"aa": 1, "bb": 1}, budget=4000.0).collect()
    t = totals(rows)
    assert t[2] < 0.02 * t.sum() and min(r.rate for r in rows) == 0.0


def test_mixing_equals_a_plain_loop(spark):
    """The replayed steps against projected gradient on dense arrays."""
    df = corpus(spark, 60)
    got = M.mixing_rates(df, df, targets={"aa": 1, "bb": 3, "cc": 1}).collect()
    p, t = np.array([r.posterior for r in got]), np.array([float(r.tokens) for r in got])
    goal = np.array([0.2, 0.6, 0.2]) * t.sum()
    inverse, r = np.linalg.pinv((p * t[:, None]).T @ p, rcond=1e-9, hermitian=True), np.ones(len(t))
    for _ in range(M.STEPS):
        rest = goal - (r * t) @ p
        if np.abs(rest).max() <= M.TOLERANCE * t.sum():
            break
        r = np.maximum(0, r + p @ (inverse @ rest))
    assert np.allclose([x.rate for x in got], r, atol=1e-6)


@pytest.mark.filterwarnings("ignore:targets are missed")
def test_mixing_reaches_the_independent_optimum(spark):
    """The objective of the rates against plain projected gradient with small steps; targets that can and cannot be met."""
    df = corpus(spark, 60)
    for targets, budget, low in (({"aa": 1, "bb": 3, "cc": 1}, None, 0.0), ({"aa": 1}, 4000.0, 0.0), ({"aa": 9, "bb": 1}, 2000.0, 0.5)):
        got = M.mixing_rates(df, df, targets=targets, budget=budget, min_rate=low).collect()
        p, t = np.array([r.posterior for r in got]), np.array([float(r.tokens) for r in got])
        goal = np.array([targets.get(x, 0) for x in ("aa", "bb", "cc")], dtype=float)
        goal *= (budget or t.sum()) / goal.sum()
        inverse = np.linalg.inv((p * t[:, None]).T @ p)

        def loss(r, p=p, t=t, goal=goal, inverse=inverse):
            rest = goal - (r * t) @ p
            return rest @ inverse @ rest

        r = np.full(len(t), max(1.0, low))
        for _ in range(60_000):
            r = np.maximum(low, r + 0.4 * (p @ (inverse @ (goal - (r * t) @ p))))
        mine = np.array([x.rate for x in got])
        assert mine.min() >= low and loss(mine) <= loss(r) * (1 + 1e-3) + 1e-4


def test_mixing_tells_what_it_misses(spark):
    df = corpus(spark, 60)
    with pytest.warns(UserWarning, match="targets are missed"):
        M.mixing_rates(df, df, targets={"aa": 1, "bb": 1}, budget=100.0, min_rate=1.0)
    with pytest.raises(ValueError, match="zz"):
        M.mixing_rates(df, df, targets={"aa": 1, "zz": 1})


def test_mixing_awkward(spark):
    assert M.mixing_rates(awkward(spark), awkward(spark)).count() == len(ROWS)
    assert M.mixing_rates(empty(spark), empty(spark)).collect() == []


class _Rows:
    """Stands for a table: a task over no batches runs at once, here."""

    def __init__(self, session):
        self.sparkSession = session

    def mapInArrow(self, task, schema):
        return list(task(iter([])))


def test_tasks_drop_what_other_operators_kept(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    kept = B.model_of(vocabulary)
    kept.encode_batch(["a few words"])
    common.mapped(_Rows(spark), lambda batches: batches, "id long", "bpe")
    assert B.model_of(vocabulary) is kept and kept.words
    common.mapped(_Rows(spark), lambda batches: batches, "id long")
    assert not B._MODELS
    assert B.model_of(vocabulary).encode_batch(["a few words"]) == kept.encode_batch(["a few words"])


def test_operators_are_sent_small_batches(spark):
    spark.conf.unset(common.BATCH)
    docs = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a few words ', 40000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    got = common.mapped(docs, sizes, "n long, b long").collect()
    assert sum(r.n for r in got) == 64 and max(r.b for r in got) <= 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH, "64m")  # a session's own setting stays
    assert max(r.n for r in common.mapped(docs, sizes, "n long, b long").collect()) == 64
    spark.conf.unset(common.BATCH)
