import random

import duckdb
import public_tokenizers
import pytest
from fixtures import SCHEMA, awkward, empty
from test_jaccard_join import brute
from test_text_scans import brute_lines
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as P
from quillstream.llm.mixing import mixing_rates
from quillstream.llm.toxicity import fit, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(160):
        lang, letters = rng.choice([("en", "etaoinsh"), ("en", "etaoinsh"), ("fr", "éàlmnpq")])
        w = [word(letters) for _ in range(40)]
        toxic = rng.random() < 0.25
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["wretchword", "vilename"]))
        text = " ".join(w[:20]) + "\n" + " ".join(w[20:]) + ("\nShared footer line of the site" if i % 4 == 0 else "")
        if i % 10 == 9:
            text = docs[-1][1] + " more"
        docs.append((i, text, lang, f"src{i % 3}", len(text)))
        labels.append((i, 1, int("wretchword" in text or "vilename" in text)))
    spark.createDataFrame(docs, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, docs


def test_stages_against_brute_force(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.drop_toxic(spark, docs, d).cache()
    scored = {r.doc_id for r in toxicity(docs, fit(docs, spark.read.parquet(f"{d}/labels.parquet"))).filter("predicted = 0").collect()}
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == scored and kept.columns == list(P.COLUMNS)
    truth = {i for i, t, *_ in rows if "wretchword" not in t and "vilename" not in t}
    assert set(left) == truth

    lines = P.dedup_lines(spark, kept, d).cache()
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    assert got == {i: (t, len(t)) for i, _, t in brute_lines(sorted(left.items()))} and lines.columns == list(P.COLUMNS)

    single = P.drop_near_duplicates(spark, lines, d).cache()
    want = brute([(i, t) for i, (t, _) in got.items()], 5, 80)
    ids = {r.doc_id for r in single.collect()}
    assert ids == {i for i in got if want[i] == i} and len(ids) < len(got) and single.columns == list(P.COLUMNS)

    mixed = P.mix(spark, single, d).cache()
    copies = {r.doc_id: r.copies for r in mixing_rates(single, single, min_rate=1.0).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == copies and set(counts) == ids and mixed.columns == list(P.COLUMNS)

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    coded = P.encode(spark, mixed, d).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in coded) == sorted((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())


def test_run_equals_its_stages_and_survives_awkward_rows(spark, tables, tmp_path):
    d, rows = tables
    assert P.run(spark, d).count() >= len({i for i, t, *_ in rows if "wretchword" not in t and "vilename" not in t}) // 2
    for df in (awkward(spark), empty(spark)):
        for name, stage in P.STAGES:
            df = stage(spark, df, d)
        df.collect()


def test_registered(spark):
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", ["op4_line_dedup", "op10_topk_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, d).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
