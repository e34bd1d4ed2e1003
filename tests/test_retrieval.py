import pytest
from pyspark.sql import functions as F

from quillstream.config import AnswerConfig, HybridConfig, RetrievalConfig
from quillstream.operators import channels, dense, siblings, sparse
from quillstream.sources import corpus

HIT = "qid long, chunk_id string, score double, rank long"


def hits(spark, rows):
    return spark.createDataFrame([(1, c, s, i + 1) for i, (c, s) in enumerate(rows)], HIT)


def test_fusion_breaks_ties_by_id(spark):
    got = channels.top_fused(channels.fuse(hits(spark, [("B", 0.9), ("A", 0.8)]), hits(spark, [("A", 12.0), ("B", 11.0)]), HybridConfig()), 10).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == ["A", "B"]
    assert (got[0].dense_rank, got[0].dense_score, got[0].sparse_rank, got[0].sparse_score) == (2, 0.8, 1, 12.0)
    assert got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61) and got[0].source_channels == ["dense", "sparse"]


def test_fusion_weights_and_cut(spark):
    got = channels.top_fused(channels.fuse(hits(spark, [("D", 1.0)]), hits(spark, [("S", 1.0)]), HybridConfig(dense_weight=2)), 1).collect()
    assert [(r.chunk_id, r.rrf_score) for r in got] == [("D", pytest.approx(2 / 61))]


def test_zero_weight_channel_keeps_its_rows(spark):
    got = channels.fuse(hits(spark, [("D", 1.0)]), hits(spark, [("S", 1.0)]), HybridConfig(dense_weight=0)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.rrf_score, r.source_channels) for r in got] == [("D", 0.0, ["dense"]), ("S", pytest.approx(1 / 61), ["sparse"])]


def test_repeated_ids_leave_rank_holes(spark):
    got = channels.fuse(hits(spark, [("A", 3.0), ("A", 2.0), ("B", 1.0)]), hits(spark, []), HybridConfig()).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.dense_rank) for r in got] == [("A", 1), ("B", 3)]


def test_payload_is_the_whole_row_of_the_first_channel(spark):
    d = hits(spark, [("A", 1.0)]).withColumn("zone", F.lit(None).cast("string"))
    s = hits(spark, [("A", 1.0), ("B", 0.5)]).withColumn("zone", F.lit("z"))
    got = {r.chunk_id: r.zone for r in channels.fuse(d, s, HybridConfig(), ("zone",)).collect()}
    assert got == {"A": None, "B": "z"}


def test_floors_are_inclusive_and_drop_nan(spark):
    rows = hits(spark, [("a", 0.7), ("b", 0.8), ("c", float("nan")), ("d", None), ("e", 0.9)])
    assert [(r.chunk_id, r["rank"]) for r in channels.above(rows, 0.8).orderBy("rank").collect()] == [("e", 1), ("b", 2)]
    assert channels.above(rows, None).count() == 5


def test_predicates_apply_after_the_cut(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [1.0, 0.1]), ("C", [0.0, 1.0]), ("Z", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    c = spark.createDataFrame([("A", "s", "z", None, None), ("B", "s", "z", True, None), ("C", "s", "z", True, False)], "chunk_id string, standard_id string, zone string, searchable boolean, inactive boolean")
    top = dense.dense_topk(q, v, 2)
    assert [r.chunk_id for r in top.orderBy("rank").collect()] == ["A", "B"]
    assert [(r.chunk_id, r["rank"]) for r in channels.post_filter(top, c).collect()] == [("B", 1)]
    assert {r.chunk_id: r.score for r in dense.dense_topk(q, v, 4).collect()}["Z"] is None
    f = spark.createDataFrame([(1, None, "other")], "qid long, want_standard string, want_zone string")
    assert channels.post_filter(top, c, f).count() == 0


def test_bm25_by_hand(spark):
    import math

    c = spark.createDataFrame([("A", "cat cat dog"), ("B", "dog"), ("C", "bird"), ("N", None)], "chunk_id string, index_text string")
    q = spark.createDataFrame([(1, "cat dog")], "qid long, question string")
    got = {r.chunk_id: r.score for r in sparse.bm25_topk(q, c.filter("chunk_id <> 'N'"), 10).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.2 * (0.25 + 0.75 * dl / (5 / 3)))
    assert got == {"A": pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3)), "B": pytest.approx(idf(2) * part(1, 1))}
    assert sparse.bm25_topk(q, c, 10).count() == 2


def seeds_of(spark, ids):
    return siblings.seeds(spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "qid long, chunk_id string, pos long"))


def test_seeds_drop_blanks_and_repeats(spark):
    got = seeds_of(spark, [" A ", " ", "B", "A"]).orderBy("seed_rank").collect()
    assert [(r.chunk_id, r.seed_rank) for r in got] == [("A", 0), ("B", 1)]


def test_siblings_and_interleave(spark):
    edges = spark.createDataFrame([("A", "P"), ("A2", "P"), ("A1", "P"), ("N", "P"), ("X", "P"), ("B", "Q"), ("A2", "Q"), ("B1", "Q"), ("A", "Q")], "chunk_id string, paragraph_id string")
    chunk = "chunk_id string, standard_id string, zone string, searchable boolean, inactive boolean, part_index int"
    c = spark.createDataFrame([("A", "s", "z", True, False, 0), ("A1", "s", "z", True, True, 1), ("A2", "s", "z", True, False, 2), ("N", "s", "z", True, False, None), ("X", "s", "z", None, False, 0), ("B", "s", "z", True, False, 0), ("B1", "s", "z", True, False, 0)], chunk)
    s = seeds_of(spark, ["B", "A"])
    sib = siblings.siblings(s, edges, c, 8)
    # A2 and B1 are reached from B first; the inactive A1 stays; X isn't searchable; seeds are no siblings
    assert [(r.chunk_id, r.seed_rank) for r in sib.orderBy("seed_rank", F.asc_nulls_last("part_index"), "chunk_id").collect()] == [("B1", 0), ("A2", 0), ("A1", 1), ("N", 1)]
    assert [r.chunk_id for r in siblings.interleave(s, sib).orderBy("pos").collect()] == ["B", "B1", "A2", "A", "A1", "N"]
    assert [r.chunk_id for r in siblings.siblings(s, edges, c, 1).collect()] == ["B1"]
    assert siblings.siblings(s, edges, c, 0).count() == 0


def test_metrics_report_filtered_questions(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    raw = spark.createDataFrame([(1, "D1"), (1, "S1")], "qid long, chunk_id string")
    top = spark.createDataFrame([], "qid long, chunk_id string, pos long")
    res = spark.createDataFrame([], "qid long, pos long, chunk_id string, candidate_source string")
    got = {r.qid: (r.raw_candidate_count, r.seed_count, r.threshold_filtered_all) for r in siblings.metrics(q, raw, top, res).collect()}
    assert got == {1: (2, 0, True), 2: (0, 0, False)}
    assert {r.raw_candidate_count for r in siblings.metrics(q, None, top, res).collect()} == {None}


def test_config_validation():
    assert HybridConfig.load({"hybrid": {"rrf_k": "10", "dense_min_score": "0.6"}}).rrf_k == 10
    assert HybridConfig.load({"seed_top_k": 3}).seed_top_k == 3 and RetrievalConfig.load({}).top_k == 6
    for bad in ({"rrf_k": 0}, {"dense_weight": 0, "sparse_weight": 0}, {"dense_weight": -1}, {"dense_min_score": float("nan")}):
        with pytest.raises(ValueError):
            HybridConfig(**bad)
    with pytest.raises(ValueError):
        AnswerConfig(max_candidates=0)
    with pytest.raises(ValueError):
        RetrievalConfig(max_siblings=-1)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_lsh_recall(spark, d):
    """Recall at 10 of the registered parameters against the exact hits."""
    v, q = corpus.vectors(spark, d), corpus.questions(spark, d).filter("embedding is not null")
    exact = {(r.qid, r.chunk_id) for r in dense.dense_topk(q, v, 10).collect()}
    found = {(r.qid, r.chunk_id) for r in dense.dense_lsh(q, v, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact), len(exact & found) / len(exact)
