import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import ROWS, awkward, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import topk_search as S
from quillstream.llm import common
from quillstream.llm import warc as A
from quillstream.llm.bpe import WordBpe, bpe_encode, op6_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        mine = WordBpe(f.read())
    lib = Tokenizer.from_file(PATH)
    lib.no_padding()
    lib.no_truncation()
    return mine, lib


def test_bpe_equals_the_library(both):
    mine, lib = both
    rng = random.Random(1)
    parts = [*"abcdeXYZ 's\t\n\x1c\x85\xa0​éÉßΣσςİıǅ0½²٣中文🙂🏽रि<|>~_-﻿", "<|endoftext|>", "<|startoftext|>", "international", "tion", "'LL", " we're "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2500)]
    texts += ["", "x" * 3000, "ab" * 2000, "internationalization antidisestablishmentarianism", *(t for _, t, *_ in ROWS if t)]
    got, want = mine.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == w.ids, t
        assert mine.decode(g) == lib.decode(w.ids, skip_special_tokens=False)


def test_bpe_both_paths_are_used(both):
    mine, _ = both
    mine.words.clear()
    words = ["the", "dog", *{"".join(random.Random(i).choice("thoeranls") for _ in range(9)) for i in range(300)}]
    n_exact = mine.learn(words)
    assert 0 < n_exact < len(words)
    for w in words:
        assert mine.words[w] == np.array([mine.vocab[t] for t in mine.merged(mine.symbols(w))], dtype="<u4").tobytes()


@pytest.mark.parametrize("bound", ["CACHE", "CACHE_BYTES"])
def test_bpe_cache_overflow(both, monkeypatch, bound):
    mine, lib = both
    monkeypatch.setattr(f"quillstream.llm.bpe.{bound}", 20)
    texts = [" ".join(f"w{i}x{j}" for j in range(9)) + "<|endoftext|>z" for i in range(30)]
    for a in range(0, 30, 3):
        for t, g in zip(texts[a : a + 3], mine.encode_batch(texts[a : a + 3]), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_rows(spark, both):
    mine, lib = both
    got = {r.doc_id: r for r in op6_bpe(awkward(spark), PATH).collect()}
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert op6_bpe(empty(spark), PATH).collect() == []
    row = bpe_encode(awkward(spark).filter("doc_id = 12"), PATH).first()
    assert mine.plain(row.ids) == "one two three "


PAGE = "page_id long, url string, html string"
PAGES = [(3, "http://c", "same"), (1, "http://a\nb", "same"), (2, None, ""), (4, "u", None), (5, "u", "x" * 300_000), (6, "u", "é🙂\r\n\r\nWARC/1.1\r\n"), (6, "u", "é🙂\r\n\r\nWARC/1.1\r\n"), (None, "n", "same"), (7, "u", "x" * 300_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, PAGE).withColumn("digest", F.lit(1)).withColumn("hit_id", F.lit(2))
    archives = A.write_archives(df)
    back = A.read_archives(archives).collect()
    assert len(back) == len(PAGES)
    by = {}
    for i, _, h in PAGES:
        by.setdefault((h or "").encode(), []).append(i)
    for r in back:
        html = next((h or "").encode() for i, _, h in PAGES if i == r.page_id)
        first = min(i for i in by[html] if i is not None)
        assert r.payload_bytes == len(html) and r.payload_digest == A.sha1_base32(html)
        if r.page_id == first:
            assert r.record_type == "response" and r.payload == html and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == first and r.payload is None
    assert A.op7_warc(df.limit(0)).collect() == []
    small = A.read_archives(A.write_archives(df, min_bytes=5)).filter("payload_bytes < 5").collect()
    assert {r.record_type for r in small} == {"response"}


def test_warc_where_payloads_are_joined(spark, monkeypatch):
    """A third of the pages have one payload, over several batches; a url is longer than a megabyte."""
    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "MANY", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = [(i, "u" * (1_200_000 if i == 7 else 3), "hot" if i % 3 == 0 else f"page {i // 2}") for i in range(900)]
        got = {r.page_id: (r.record_type, r.refers_to) for r in A.op7_warc(spark.createDataFrame(rows, PAGE)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, _, h in rows}


def test_warc_files(spark, tmp_path):
    for r in A.write_archives(spark.createDataFrame(PAGES, PAGE)).collect():
        (tmp_path / r.archive).write_bytes(r.data)
    assert A.read_files(spark, str(tmp_path)).count() == len(PAGES)


def test_warc_reader_rejects_damage():
    good = A.page_record(1, "u", b"payload", A.sha1_base32(b"payload"), "response", None)
    assert [A.payload_of(r) for r in A.read_warc(good + good, piece=7)] == [b"payload"] * 2
    with pytest.raises(A.WarcError):
        list(A.read_warc(good[:-9]))
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"payload", b"paYload"), raw.replace(b"WARC/1.1", b"XARC/1.1"), raw.replace(b"Content-Length: ", b"Content-Length: 9"), b"nothing"):
        z = zlib.compressobj(wbits=31)
        with pytest.raises(A.WarcError):
            list(A.read_warc(z.compress(bad) + z.flush()))
    with pytest.raises(A.WarcError):
        A.payload_of(A.Record({"warc-payload-digest": "sha1:AAAA"}, b"h\r\n\r\nx"))


def brute_topk(rows, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)))
    out = []
    for i in {i for i, _ in ok if i % 50 == 0}:
        s = sorted((-int(np.dot(a, b)), j) for n, a in ok for j, b in ok if n == i and j != i and len(a) == len(b))[:k]
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


VEC = "vec_id long, embedding array<float>"


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BINS", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 460)]  # ties
    rows += [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [1.0] * 3), (701, [2.0] * 3), (None, [1.0] * 8), (50, [9.0] * 8), (750, [])]
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit(1)).withColumn("q", F.lit(1))
    got = sorted(tuple(r) for r in S.topk_search(df, lambda c: F.pmod(c, F.lit(50)) == 0, 5, block=4).collect())
    assert got == brute_topk(rows, 5)
    con = duckdb.connect()
    same = [(i, v) for i, v in rows if v is not None and len(v) == 8]  # SQL has no rule for unequal lengths
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in same]), "embedding": pa.array([v for _, v in same], pa.list_(pa.float32()))}))
    assert sorted(con.sql(S.ORACLE).fetchall()) == sorted(tuple(r) for r in S.op10_topk_search(spark.createDataFrame(same, VEC)).collect())
    assert S.op10_topk_search(df.limit(0)).collect() == []
    for large in (1e17, 5e18, 1e300):
        with pytest.raises(ValueError):
            S.op10_topk_search(spark.createDataFrame([(0, [1.0]), (1, [large])], "vec_id long, embedding array<double>"))


def test_bpe_refuses_other_files():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"decoder": {"type": "ByteLevel"}}):
        with pytest.raises(ValueError):
            WordBpe(json.dumps(spec | change))


def test_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": type("Context", (), {"master": "spark://host:7077"})()})()
    with pytest.raises(RuntimeError):
        common.shared_dir(session)
