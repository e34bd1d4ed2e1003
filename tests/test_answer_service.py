import json

import pytest
from pyspark.sql import functions as F

from quillstream.config import AnswerConfig
from quillstream.operators import evidence, service
from quillstream.operators.admission import admitted_jobs, job_step, job_trace, limiter_step, rate_limit
from quillstream.streaming import admission as stream

RESULT = "qid long, pos long, chunk_id string, text string, contextualized_text string, citation_label string, standard_id string, candidate_source string"


def results(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], RESULT)


def test_budget_lengths_and_numbers(spark):
    rows = results(spark, [(f"C{i}", "x" * 20, None, "l", None, "hybrid") for i in range(3)])
    config = AnswerConfig(max_candidates=2, max_candidate_chars=5, max_context_chars=8)
    got = evidence.catalog(evidence.candidates(rows, config), config).orderBy("evidence_no").collect()
    assert [(r.evidence_id, len(r.statement)) for r in got] == [("E1", 5), ("E2", 3)]


def test_blank_context_is_skipped_and_numbers_close_up(spark):
    rows = results(spark, [("A", "t", "  ", "l", None, None), ("B", "t", "", "l", None, None), ("A", "t", None, "l", None, None), (" ", "t", None, "l", None, None)])
    c = evidence.candidates(rows, AnswerConfig())
    assert [r.error for r in c.orderBy("pos").collect()] == [None, None, "duplicate id", "empty id"]
    assert [(r.evidence_id, r.source_id) for r in evidence.catalog(c, AnswerConfig()).orderBy("evidence_no").limit(1).collect()] == [("E1", "B")]


def test_closed_form_equals_the_loop(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        lens, cap, budget = [rng.randrange(0, 12) for _ in range(15)], rng.randrange(1, 9), rng.randrange(1, 60)
        config = AnswerConfig(max_candidates=20, max_candidate_chars=cap, max_context_chars=budget)
        rows = results(spark, [(f"C{i}", "y" * n, None, "l", None, None) for i, n in enumerate(lens)])
        want, used = [], 0
        for n in lens:
            if n and used < budget:
                want.append(min(n, cap, budget - used))
                used += want[-1]
        assert [len(r.statement) for r in evidence.catalog(evidence.candidates(rows, config), config).orderBy("evidence_no").collect()] == want


def test_citations_join_back_in_order(spark):
    items = evidence.catalog(evidence.candidates(results(spark, [("A", "ta", None, "la", None, "hybrid"), ("B", "tb", None, "lb", None, "sibling")]), AnswerConfig()), AnswerConfig())

    def model(_):
        out = {"conclusion": " c [E2] ", "reasoning": ["x [E1]", " "], "evidence": ["E9", "E2", "E2"]}
        return spark.createDataFrame([(1, json.dumps(out))], "qid long, model_output string")

    got = evidence.answer(items, model).first()
    assert got.conclusion == "c [E2]" and got.reasoning == ["x [E1]"] and got.error is None
    assert [(e.evidence_id, e.citation, e.statement) for e in got.evidence] == [("E2", "lb", "tb"), ("E1", "la", "ta")]


def test_payload_errors(spark):
    rows = [(1, ""), (2, None), (3, "[1]"), (4, '{"conclusion":" "}'), (5, '{"conclusion":"c"}'), (6, '{"conclusion": "c"'), (7, "{x}")]
    got = {r.qid: r.error for r in evidence.parse_payload(spark.createDataFrame(rows, "qid long, model_output string")).collect()}
    assert got == {1: "empty output", 2: "empty output", 3: "not an object", 4: "empty conclusion", 5: None, 6: "malformed", 7: "malformed"}


def test_prompt_leaves_out_an_empty_question(spark):
    items = evidence.catalog(evidence.candidates(results(spark, [("A", "가", None, "l", None, None)]), AnswerConfig()), AnswerConfig())
    q = spark.createDataFrame([(1, "  ")], "qid long, question string")
    text = evidence.prompt_body(q, items).first().body
    body = json.loads(text)
    assert text == json.dumps(body, ensure_ascii=False)
    assert list(body) == ["evidence"] and body["evidence"][0]["statement"] == "가"


def test_gate_and_errors(spark):
    g = service.gate(F.col("n"), F.col("f"))
    df = spark.createDataFrame([(0, True), (0, False), (2, False)], "n long, f boolean").select(g["reason"].alias("r"))
    assert [r.r for r in df.collect()] == ["no_supported_evidence", "no_evidence_found", "evidence_available"]
    e = spark.createDataFrame([("ValueError", None), ("RuntimeError", "openai.x"), ("RuntimeError", "app"), (None, None), ("TimeoutError", "x")], "c string, m string")
    assert [r.s for r in e.select(service.http_status(F.col("c"), F.col("m")).alias("s")).collect()] == [422, 503, 500, None, 503]


def test_request_and_image_rules(spark):
    rows = [("", 0, "1109", None, 10, None), ("q", 0, "1110", "nope", 0, "x"), ("x" * 2001, 5, None, None, 51, "123e4567-e89b-12d3-a456-426614174000"), (" ", 1, None, None, 1, None)]
    df = spark.createDataFrame(rows, "q string, n int, s string, z string, k int, r string")
    got = [r.e for r in df.select(service.request_errors(*map(F.col, "qnszkr")).alias("e")).collect()]
    assert got == [["question_or_image"], ["standard_id", "zone", "top_k", "request_id"], ["question_length", "images", "top_k"], []]
    img = spark.createDataFrame([("image/png", "YQ=="), ("image/png", "Y Q=="), ("image/png", "YQ==\n"), ("text/plain", ""), ("image/gif", "YQ")], "m string, d string")
    got = [r.e for r in img.select(service.image_errors(F.col("m"), F.col("d"), F.lit("n")).alias("e")).collect()]
    assert got == [[], ["base64"], ["base64"], ["mime_type", "data_length"], ["base64"]]


def test_base64_and_size_against_the_decoder(spark):
    import base64
    import binascii
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("AZaz09+/==\n _") for _ in range(rng.randrange(10))) for _ in range(800)] + [base64.b64encode(bytes(n)).decode() for n in (0, 1, 2, 3, 4)]
    most = service.IMAGE_BYTES
    texts += [base64.b64encode(bytes(n)).decode() for n in (most, most + 1, most + 2)]

    def broken(t):
        try:
            decoded = base64.b64decode(t, validate=True)
        except (binascii.Error, ValueError):
            return ["base64"]
        return ["too_large"] if len(decoded) > most else []

    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [[e for e in r.e if e != "data_length"] for r in df.select(service.image_errors(F.lit("image/png"), F.col("d"), F.lit("n")).alias("e")).collect()]
    assert got == [broken(t) for t in texts]


def test_answer_text(spark):
    df = spark.createDataFrame([("c", ["a", "b"], [("E1", "cit", "[t]\nbody")]), ("c", [], [])], "c string, r array<string>, e array<struct<evidence_id: string, citation: string, statement: string>>")
    got = [r.t for r in df.select(service.answer_text(F.lit("answered"), F.col("c"), F.col("r"), F.col("e")).alias("t")).collect()]
    assert got == ["답변\nc\n\n근거\n1. a\n2. b\n\n참조\n[E1] cit\nbody", f"답변\nc\n\n참조\n{service.NO_EVIDENCE_TEXT}"]


def loop_limiter(times, span, limit):
    recent, out = [], []
    for t in times:
        recent = [x for x in recent if t - x <= span]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def test_limiter_boundary_and_rejects(spark):
    secs = [0, 1, 5, 10, 11, 11, 12, 30]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(secs)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 10**9))
    got = [r.allowed for r in rate_limit(rows, 10, 2).orderBy("id").collect()]
    assert got == loop_limiter(secs, 10, 2) == [True, True, False, False, True, False, True, True]
    assert all(r.allowed for r in rate_limit(rows, 10, 0).collect())


CALLS = [(0, "get"), (1, "create"), (2, "create"), (601, "get"), (602, "create"), (700, "finish"), (1300, "get"), (1301, "get"), (1302, "fail"), (1303, "create"), (2000, "finish"), (2100, "get"), (2101, "delete"), (2102, "get"), (2103, "create")]


def test_jobs_expire_on_looks_only(spark):
    rows = spark.createDataFrame([(7, i, s * 1_000_000, op) for i, (s, op) in enumerate(CALLS)], "key long, id long, us long, op string")
    got = [(r.outcome, r.job_no) for r in job_trace(rows).orderBy("id").collect()]
    state, want = (None, 0, 0), []
    for s, op in CALLS:
        *state, outcome = job_step(*state, s * 1_000_000, op, 600_000_000)
        want.append((outcome, state[2]))
    assert got == want
    # exactly 600 s is alive, later is not, and a late finish revives an unseen job
    assert [w[0] for w in want] == ["none", "created", "existing", "pending", "created", "done", "complete", "none", "none", "created", "done", "complete", "done", "none", "created"]


def run_stream(df, name, spark, path):
    q = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(f"{path}/{name}")


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    if batch.count() == 0:
        pytest.skip("no events")
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = run_stream(stream.rate_limit_stream(live, 86_400, 2), "limit", spark, str(tmp_path))
    want = rate_limit(batch, 86_400, 2)
    assert sorted(map(tuple, got.select("id", "key", "allowed").collect())) == sorted(map(tuple, want.select("id", "key", "allowed").collect()))
    calls = spark.createDataFrame([(i % 3, i, 10**15 + i * 200_000_000, CALLS[i % len(CALLS)][1]) for i in range(90)], "key long, id long, us long, op string")
    (tmp_path / "calls").mkdir()
    calls.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "calls"))
    jobs = stream.job_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")))
    got = run_stream(jobs, "jobs", spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, job_trace(calls).collect()))


def test_timers_remove_state(spark, tmp_path):
    """Once the watermark is past the window, a key's state is gone."""
    schema = "user_id long, event_id long, s long"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(([(1, 0, 0), (2, 1, 5)], [(3, 2, 5000)], [(3, 3, 9000)], [(3, 4, 9001)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        next((tmp_path / f"p{n}").glob("*.parquet")).rename(tmp_path / "in" / f"{n}.parquet")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("s") + 10**9))
    q = stream.rate_limit_stream(live, 10, 2).writeStream.format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1] == 1
    assert sorted(r.id for r in spark.table("limits").collect()) == [0, 1, 2, 3, 4]


def test_limiter_is_linear_in_a_key(spark):
    import time

    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    began = time.time()
    assert rate_limit(rows, 10, 3).filter("allowed").count() == sum(i % 11 < 3 for i in range(n))
    assert time.time() - began < 30


def test_quota_inside_create(spark):
    """A live request takes no quota, a refused one stores nothing, none is a job of its own."""
    calls = [(0, "a"), (1, "a"), (2, "b"), (3, None), (4, "a"), (5, "b"), (700, "a"), (701, "b"), (702, "c"), (2000, "b")]
    rows = spark.createDataFrame([(9, i, s * 1_000_000, r) for i, (s, r) in enumerate(calls)], "key long, id long, us long, request string")
    got = [r.outcome for r in admitted_jobs(rows, 1000, 3).orderBy("id").collect()]
    assert got == ["created", "existing", "created", "created", "existing", "existing", "refused", "refused", "refused", "created"]
    jobs, recent, want = {}, [], []
    for s, r in calls:
        jobs = {k: t for k, t in jobs.items() if s - t <= 600}
        if r in jobs:
            want.append("existing")
            continue
        recent, ok = limiter_step(recent, s, 1000, 3)
        want.append("created" if ok else "refused")
        if ok and r:
            jobs[r] = s
    assert got == want
