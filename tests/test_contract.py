import json

import pytest
from pyspark.sql import functions as F

from quillstream.config import AnswerConfig, HybridConfig, RetrievalConfig, read_yaml
from quillstream.operators import contract, dense, evidence, scan, sparse
from quillstream.plans import pipeline
from quillstream.plans.retrieval import Retrieval

DIR = "/root/testdata/sf0.001"
SETTINGS = """
answer:
  max_candidates: 20
  max_context_chars: 50000
hybrid:
  seed_top_k: 10
  dense_min_score: 0.60
retrieval:
  top_k: 10
"""


def test_settings_by_section(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(SETTINGS)
    data = read_yaml(str(tmp_path / "s.yaml"))
    assert AnswerConfig.load(data) == AnswerConfig(max_context_chars=50000)
    assert HybridConfig.load(data) == HybridConfig(seed_top_k=10, dense_min_score=0.6) and RetrievalConfig.load(data) == RetrievalConfig(top_k=10)


def test_requests_are_read_strictly(spark):
    image = {"mime_type": "image/png", "data": "YQ=="}
    rows = [
        {"question": " q ", "debug": True}, {"question": "q", "limit": 1}, {"images": [image]}, {"images": [image | {"size": 1}]}, {"question": "q", "top_k": "7"}, {"question": "q", "top_k": "x"},
        {"question": "q", "images": "x"}, {"question": "q", "images": [{"mime_type": "text/plain", "data": "Y"}]}, {}, {"question": "x" * 2001, "zone": "nowhere"}, {"question": "q", "top_k": 0}, {"question": None, "images": []},
    ]
    texts = [json.dumps(r) for r in rows] + ["", None, "[]", '{"question": "q"', "7"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, body string, question_id string")
    got = {r.id: r for r in contract.read_requests(df).collect()}
    want = {
        0: [], 1: ["unknown_key"], 2: [], 3: ["unknown_image_key"], 4: [], 5: ["type"], 6: ["type"], 7: ["mime_type", "base64"], 8: ["question_or_image"], 9: ["question_length", "zone"], 10: ["top_k"], 11: ["question_or_image"],
        12: ["json"], 13: ["json"], 14: ["json"], 15: ["json"], 16: ["json"],
    }
    assert {i: r.errors for i, r in got.items()} == want
    assert (got[0].question, got[0].top_k, got[0].debug, got[4].top_k, got[2].images[0].name, got[13].top_k, got[0].question_id) == ("q", 10, True, 7, "image", None, "kept")


def test_json_strings(spark):
    texts = ["", 'a"b\\c/d', "가\n\t\r\x08\x0c\x01\x1f\x7f", "🙂 ñ", None]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(evidence.json_string(F.col("t")).alias("j")).collect()]
    assert [None if j is None else json.loads(j) for j in got] == texts


def test_responses_leave_out_nulls(spark):
    r = Retrieval(spark, DIR)
    answers = spark.createDataFrame([(1, "c", ["s"], [("E1", "cit", "st", None)])], "qid long, conclusion string, reasoning array<string>, evidence array<struct<evidence_id: string, citation: string, statement: string, pdf_page_start: int>>")
    metrics = spark.createDataFrame([(1, 3, 1, 0, 1, False), (2, 3, 0, 0, 0, True), (3, 0, 0, 0, 0, False)], "qid long, raw_candidate_count long, seed_count long, sibling_count long, result_count long, threshold_filtered_all boolean")
    questions = spark.createDataFrame([(i, "q", None, "z") for i in (1, 2, 3)], "qid long, question string, want_standard string, want_zone string")
    got = {x.qid: json.loads(x.body) for x in contract.public_response(answers, metrics, questions, F.col("qid") == 2).collect()}
    assert got[1] == {"status": "answered", "reason": "evidence_available", "conclusion": "c", "reasoning": ["s"], "evidence": [{"evidence_id": "E1", "citation": "cit", "statement": "st"}]}
    assert got[2]["reason"] == "no_supported_evidence" and got[2]["evidence"] == [] and len(got[2]["reasoning"]) == 1
    assert got[2]["diagnostics"]["retrieval"] == {"filters": {"zone": "z"}, "seed_count": 0, "sibling_count": 0, "result_count": 0, "raw_candidate_count": 3, "threshold_filtered_all": True}
    assert got[3]["reason"] == "no_evidence_found" and "diagnostics" not in got[3]
    assert r.metrics.columns == metrics.columns


def test_score_events_hide_the_question(spark):
    q = spark.createDataFrame([(1, "ask", None, "z"), (2, "b", None, None)], "qid long, question string, want_standard string, want_zone string")
    hits = spark.createDataFrame([(1, "B", 2, 0.4), (1, "A", 1, 0.7)], "qid long, chunk_id string, rank long, score double")
    none = hits.limit(0)
    chosen = hits.select("qid", "chunk_id", F.col("rank").alias("pos"))
    got = {r.qid: json.loads(r.event) for r in contract.score_events(q, hits, none, chosen, (0.5, None)).collect()}
    assert [(h["chunk_id"], h["passed"]) for h in got[1]["dense"]] == [("A", True), ("B", False)] and got[1]["sparse"] == [] and got[1]["selected_chunk_ids"] == ["A", "B"]
    assert got[1]["filters"] == {"standard_id": None, "zone": "z"} and got[1]["thresholds"] == {"dense": 0.5, "sparse": None}
    assert "question" not in got[1] and got[2]["dense"] == []
    assert json.loads(contract.score_events(q, hits, none, chosen, (0.5, None), True).filter("qid = 1").first().event)["question"] == "ask"


class Stub:
    """Finds one chunk for questions that don't ask for nothing; keeps what it was asked."""

    def retrieve(self, questions):
        self.asked = questions
        rows = questions.filter("dense_query <> 'nothing'").select("qid", F.lit(1).cast("long").alias("pos"), F.lit("C1").alias("chunk_id"), F.col("sparse_query").alias("text"))
        return rows, questions.select("qid", F.when(F.col("dense_query") != "nothing", 1).otherwise(0).alias("result_count"), F.lit(True).alias("threshold_filtered_all"))


def test_pipeline_with_injected_models(spark):
    schema = "qid long, question string, images array<string>"
    requests = spark.createDataFrame([(1, " ask ", []), (2, "nothing", None), (3, " ", []), (4, "with image", ["i"]), (5, "", ["i"]), (6, "x", ["bad"])], schema)
    seen = []

    def analyst(df):
        seen.append(sorted(r.qid for r in df.collect()))
        done = F.when(F.col("images")[0] == "bad", "incomplete").otherwise("completed")
        return df.select("qid", done.alias("status"), F.lit(" semantic ").alias("semantic_query"), F.array(F.lit("k1"), F.lit(" k1 "), F.lit("k2")).alias("keywords"))

    retriever = Stub()
    got = {r.qid: r for r in pipeline.AnswerPipeline(retriever, evidence.answer, analyst).ask(requests).collect()}
    assert seen == [[4, 5, 6]]
    asked = {r.qid: (r.dense_query, r.sparse_query, r.question) for r in retriever.asked.collect()}
    assert asked[1][:2] == ("ask", "ask") and asked[4] == ("semantic", "k1 k2", "with image") and asked[5][:2] == ("semantic", "k1 k2") and set(asked) == {1, 2, 4, 5}
    assert (got[1].status, got[1].evidence[0].statement, got[4].evidence[0].statement) == ("answered", "ask", "k1 k2")
    assert got[2].reason == "no_supported_evidence" and got[3].error == "question must not be empty" and got[6].error == "image search analysis did not complete" and got[6].status is None


def test_probe(spark, tmp_path):
    assert pipeline.probe(spark, DIR) == {"documents": 1, "labels": 1, "embeddings": 1, "benchmark": 1}
    with pytest.raises(pipeline.MissingInput, match="documents"):
        pipeline.probe(spark, str(tmp_path))
    with pytest.raises(pipeline.MissingInput, match="KEY: not set"):
        pipeline.probe(spark, DIR, settings=("NAME", "KEY"), values={"NAME": "x", "KEY": " "})


def test_injected_embedding(spark):
    """Each question gets the vector of one chunk, which then is its best hit."""
    vectors = Retrieval(spark, DIR).spark.read.parquet(f"{DIR}/embeddings.parquet").select("embedding").first().embedding
    r = Retrieval(spark, DIR, embed=lambda q: q.select("qid", F.array(*map(F.lit, vectors)).alias("embedding")))
    best = r.dense_raw.filter("rank = 1").select("score").distinct().collect()
    assert [round(x.score, 6) for x in best] == [1.0] and r.dense_raw.select("qid").distinct().count() == r.questions.count()


def test_scan_topk_in_blocks_and_with_odd_vectors(spark, monkeypatch):
    """Several blocks of questions, several batches a task; null, short and zero vectors rank last; equal scores by id."""
    import random

    rng = random.Random(8)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    vectors = [(f"D{i:03d}", vec()) for i in range(120)] + [("Z1", None), ("Z2", [1.0]), ("Z3", [0.0, 0.0, 0.0]), ("Z4", [1.0, None, 0.0])]
    questions = [(i, vec()) for i in range(30)] + [(99, [0.0, 0.0, 0.0]), (98, None)]
    q = spark.createDataFrame(questions, "qid long, embedding array<double>")
    v = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>").repartition(3)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in b:
            return None
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round((1 + sum(x * y for x, y in zip(a, b, strict=True)) / n) / 2, 9) if n else None

    for block, tile in ((16_384, 1 << 21), (8, 600)):
        monkeypatch.setattr(scan, "QUESTION_BLOCK", block)
        monkeypatch.setattr(scan, "TILE", tile)
        got = {}
        for r in dense.dense_topk(q, v, 7).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, r.score))
        for qid, e in questions:
            want = sorted(((c, cosine(e, x)) for c, x in vectors), key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:7]
            assert [c for c, _ in got[qid]] == [c for c, _ in want]
            assert all(a == b if a is None or b is None else abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got[qid], want, strict=True))
    assert dense.dense_topk(q.limit(0), v, 5).collect() == []
    assert len(dense.dense_topk(q.limit(1), v.limit(0), 5).collect()) == 0


def test_bm25_with_null_and_empty_texts(spark):
    chunks = spark.createDataFrame([("A", "red fish the fish"), ("B", None), ("C", ""), ("D", "blue fish"), ("E", "blue fish")], "chunk_id string, index_text string")
    q = spark.createDataFrame([(1, "the fish"), (2, None), (3, ""), (4, "unknown"), (5, "blue blue")], "qid long, question string")
    got = {}
    for r in sparse.bm25_topk(q, chunks, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {1: ["A", "D"], 5: ["D", "E"]}
    assert sparse.bm25_topk(q, chunks.limit(0), 2).collect() == []


def test_stored_history(spark):
    good = {"id": "a", "title": "t", "messages": [1]}
    rows = [json.dumps([good, {"id": "b"}, 3, good | {"id": "c", "messages": "x"}]), "x", None, "{}", json.dumps([good] * 40)]
    got = contract.stored_history(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "client long, value string"))
    n = {r.client: r.n for r in got.groupBy("client").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 1, 4: 30}


def test_empty_tables_nulls_and_further_columns(spark):
    """Empty inputs give empty results; null ids and scores are dropped by floors and seeds; columns beyond those named are ignored."""
    from quillstream.operators import channels, siblings

    hits = spark.createDataFrame([(1, "A", 0.9, 1), (1, None, 0.8, 2), (1, "B", None, 3), (2, " ", float("nan"), 1)], "qid long, chunk_id string, score double, rank long")
    wide = hits.withColumn("channel", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("at", F.lit(0)).withColumn("payload", F.lit("y"))
    none = hits.limit(0)
    config = HybridConfig()
    assert [(r.qid, r.chunk_id) for r in channels.above(wide, 0.5).orderBy("rank").collect()] == [(1, "A"), (1, None)]
    fused = channels.fuse(wide, wide, config)
    assert fused.count() == 4 and channels.fuse(none, none, config).collect() == []
    seeds = siblings.seeds(channels.top_fused(channels.fuse(wide, none, config), 10))
    assert sorted(r.chunk_id for r in seeds.collect()) == ["A", "B"]
    edges = spark.createDataFrame([("A", "P"), ("C", "P"), (None, "P"), ("D", None)], "chunk_id string, paragraph_id string").withColumn("seed_rank", F.lit(9))
    chunks = spark.createDataFrame([("A", "1", "z", True, 1), ("C", None, None, True, None), ("D", "1", "z", None, 1)], "chunk_id string, standard_id string, zone string, searchable boolean, part_index int").withColumn("qid", F.lit(5))
    found = siblings.siblings(seeds, edges.select("chunk_id", "paragraph_id"), chunks, 8)
    assert [(r.qid, r.chunk_id) for r in found.collect()] == [(1, "C")]
    assert siblings.siblings(seeds.limit(0), edges.select("chunk_id", "paragraph_id"), chunks, 8).collect() == []
    rows = siblings.interleave(seeds.limit(0), found.limit(0)).withColumn("text", F.lit("t")).withColumn("item", F.lit(1))
    assert evidence.catalog(evidence.candidates(rows, AnswerConfig()), AnswerConfig()).collect() == []
    blank = spark.createDataFrame([(1, None)], "qid long, model_output string").withColumn("error", F.lit("x"))
    assert evidence.parse_payload(blank).first().error == "empty output"
