"""Queries by name; each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.config import HybridConfig
from quillstream.functions import text as T
from quillstream.operators import admission, channels, contract, dense, evidence, service
from quillstream.plans.retrieval import Retrieval
from quillstream.sources import corpus

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Parameters of the admission queries, chosen so that limits and lifetimes bind on the event table.
RATE_WINDOW, RATE_LIMIT, JOB_TTL = 86_400, 2, 86_400
CLIENTS = 50


def query(f: Callable) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def plan_query(f: Callable) -> Callable:
    """A query of the retrieval plan."""
    _QUERIES[f.__name__] = lambda spark, d: f(Retrieval(spark, d))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


@plan_query
def q01_dense_topk(r):
    return _hits(r.dense_raw)


@plan_query
def q02_dense_postfilter(r):
    return _hits(r.dense)


@plan_query
def q03_dense_param_filter(r):
    return _hits(channels.post_filter(r.dense_raw, r.chunks, r.filters))


@plan_query
def q03b_dense_lsh(r):
    """Approximate hits and whether the exact top 10 has them."""
    asked = r.questions.filter("embedding is not null")
    found = dense.dense_lsh(asked, corpus.vectors(r.spark, r.dir), 10)
    exact = r.dense_raw.filter("rank <= 10").select("qid", "chunk_id", F.lit(True).alias("in_exact"))
    return _hits(found).join(exact, ["qid", "chunk_id"], "left").na.fill(False, ["in_exact"])


@plan_query
def q04_bm25_topk(r):
    return _hits(r.sparse_raw)


@plan_query
def q05_bm25_postfilter(r):
    return _hits(r.sparse)


@plan_query
def q06_bm25_param_filter(r):
    return _hits(channels.post_filter(r.sparse_raw, r.chunks, r.filters))


@plan_query
def q07_channel_threshold(r):
    a = _hits(r.dense_above).withColumn("channel", F.lit("dense"))
    return a.unionByName(_hits(r.sparse_above).withColumn("channel", F.lit("sparse")))


def _fused(df: DataFrame) -> DataFrame:
    return df.select("qid", "chunk_id", "dense_rank", F.round("dense_score", 6).alias("dense_score"), "sparse_rank", F.round("sparse_score", 6).alias("sparse_score"), F.round("rrf_score", 9).alias("rrf_score"), F.array_join("source_channels", "+").alias("channels"))


@plan_query
def q08_rrf_fuse(r):
    return _fused(r.fused)


@plan_query
def q09_rrf_weighted_topk(r):
    config = HybridConfig(dense_weight=2.0, sparse_weight=1.0)
    top = channels.top_fused(channels.fuse(r.dense_above, r.sparse_above, config), 10)
    return top.select("qid", "pos", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"))


@plan_query
def q10_seed_limit(r):
    return r.seeds


@plan_query
def q11_score_log(r):
    """The score log, one row per logged hit: hash of the question, raw rank, whether it passed its floor, whether it was selected."""
    hashed = r.questions.select("qid", F.sha2(F.encode("question", "UTF-8"), 256).alias("question_hash"))
    a = r.dense.select("qid", F.lit("dense").alias("channel"), "chunk_id", "rank", "score", channels.passes(F.col("score"), r.hybrid.dense_min_score).alias("passed"))
    b = r.sparse.select("qid", F.lit("sparse").alias("channel"), "chunk_id", "rank", "score", channels.passes(F.col("score"), r.hybrid.sparse_min_score).alias("passed"))
    chosen = channels.top_fused(r.fused, r.hybrid.seed_top_k).select("qid", "chunk_id", F.lit(True).alias("selected"))
    rows = a.unionByName(b).join(hashed, "qid").join(chosen, ["qid", "chunk_id"], "left")
    return rows.select("qid", "question_hash", "channel", "chunk_id", "rank", F.round("score", 6).alias("score"), "passed", F.coalesce("selected", F.lit(False)).alias("selected"))


@plan_query
def q12_siblings(r):
    return r.siblings


@plan_query
def q13_interleave(r):
    return r.results


@plan_query
def q14_retrieval_metrics(r):
    return r.metrics


@query
def q15_citation(spark, d):
    c = corpus.chunks(spark, d)
    par = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), (F.col("doc_id") % 50).cast("string")))
    std = F.when(F.col("doc_id") % 7 != 0, F.col("standard_id"))
    alias = F.when(F.col("doc_id") % 10 == 0, F.lit(" 부록 A "))
    return c.select("chunk_id", T.citation(F.col("citation_label"), alias, std, par, F.col("chunk_id")).alias("citation"))


@plan_query
def q16_candidate_slice(r):
    return r.candidates.select("qid", "pos", "source_id", F.length("body").cast("long").alias("n_chars"), "citation", "error")


@plan_query
def q17_evidence_budget(r):
    return r.items.select("qid", "evidence_id", "source_id", F.length("statement").cast("long").alias("n_chars"), F.md5(F.encode("statement", "UTF-8")).alias("statement_md5"))


@plan_query
def q18_evidence_metadata(r):
    return r.items.select("qid", "evidence_id", "citation", "pdf_page_start", "pdf_page_end", "candidate_source")


@plan_query
def q19_prompt_body(r):
    return evidence.prompt_body(r.questions, r.items)


@plan_query
def q20_cited_ids(r):
    cited = evidence.cited_ids(evidence.parse_payload(evidence.stub_model(r.items)))
    return cited.select("qid", F.col("at").cast("long").alias("cite_no"), "evidence_id")


@plan_query
def q21_citation_join(r):
    cited = evidence.cited_ids(evidence.parse_payload(evidence.stub_model(r.items)))
    return evidence.cited_evidence(cited, r.items).select("qid", F.col("at").cast("long").alias("cite_no"), "evidence_id", "citation", F.md5(F.encode("statement", "UTF-8")).alias("statement_md5"), "candidate_source")


@query
def q22_payload_parse(spark, d):
    c = corpus.table(spark, d, "conversations")
    key, kind = F.concat_ws("-", "conv_id", "turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    payload = F.to_json(F.struct(F.concat(F.lit(" "), "text", F.lit("  ")).alias("conclusion"), F.array(F.col("role"), F.lit("  "), F.lit(" x ")).alias("reasoning"), F.array(F.lit(" E1"), F.lit("E2")).alias("evidence")))
    blank = F.to_json(F.struct(F.lit("  ").alias("conclusion"), F.array(F.lit("a")).alias("reasoning"), F.array(F.lit("E1")).alias("evidence")))
    out = F.when(kind == 1, F.lit("  ")).when(kind == 2, F.lit("[1]")).when(kind == 3, blank).otherwise(payload)
    p = evidence.parse_payload(c.select(key.alias("qid"), out.alias("model_output")))
    return p.select("qid", F.when(F.col("error").isNull(), F.col("conclusion")).alias("conclusion"), F.when(F.col("error").isNull(), F.array_join("reasoning", "|")).alias("reasoning"), F.when(F.col("error").isNull(), F.array_join("declared", "|")).alias("declared"), "error")


@plan_query
def q24_answer_end_to_end(r):
    return evidence.answer(r.items).select("qid", "conclusion", F.array_join("reasoning", "|").alias("reasoning"), F.to_json("evidence").alias("evidence"), "error")


@plan_query
def q25_qa_gate(r):
    g = service.gate(F.col("result_count"), F.col("threshold_filtered_all"))
    return r.metrics.select("qid", *[c.alias(k) for k, c in g.items()])


def _picked(c, *values):
    """One of the values by a number column; None is null."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(F.pmod(c, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


STATUSES = ("answered", "insufficient", "generation_failed", "pending", None)
REASONS = ("sufficient", "evidence_available", *service.INSUFFICIENT_REASONS, *service.SYSTEM_ERROR_REASONS, None)
ERRORS = (None, "ValueError", "ConnectionError", "TimeoutError", "PipelineUnavailable", "RuntimeError", "APIError")
MODULES = ("builtins", "neo4j.exceptions", "openai", "neo4jx", None)


@query
def q26_result_kind(spark, d):
    e = corpus.table(spark, d, "events")
    return e.select("event_id", service.result_kind(_picked(F.col("event_id"), *STATUSES), _picked(F.floor(F.col("event_id") / 5), *REASONS)).alias("kind"))


@query
def q27_reason_fallback(spark, d):
    e = corpus.table(spark, d, "events")
    return e.select("event_id", service.fallback_reason(_picked(F.col("event_id"), *STATUSES, ""), _picked(F.floor(F.col("event_id") / 6), "partial", "", None)).alias("reason"))


@query
def q28_error_map(spark, d):
    e = corpus.table(spark, d, "events")
    status = service.http_status(_picked(F.col("event_id"), *ERRORS), _picked(F.floor(F.col("event_id") / 7), *MODULES))
    rows = e.select("event_id", F.when(F.col("event_id") % 35 == 0, 429).otherwise(status).alias("http_status"))
    return rows.select("event_id", F.col("http_status").cast("long").alias("http_status"), service.error_detail(F.col("http_status")).alias("detail"), service.error_guidance(F.col("http_status")).alias("guidance"))


@plan_query
def q29_public_response(r):
    """Public columns for all, diagnostics where the request asks for them (odd questions)."""
    g = service.gate(F.col("result_count"), F.col("threshold_filtered_all"))
    debug = F.col("qid") % 2 == 1
    diagnostics = ("seed_count", "sibling_count", "result_count", "raw_candidate_count", "threshold_filtered_all")
    return r.metrics.select("qid", g["status"].alias("status"), g["reason"].alias("reason"), g["conclusion"].alias("conclusion"), *[F.when(debug, F.col(c)).alias(f"diag_{c}") for c in diagnostics])


@query
def q31_request_validation(spark, d):
    c = corpus.table(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    question = F.when(n % 6 == 0, F.lit("  ")).when(n % 6 == 1, F.repeat("text", 8)).otherwise(F.col("text"))
    request_id = F.when(n % 4 == 0, F.lit("123e4567-e89b-12d3-a456-426614174000")).when(n % 4 == 1, F.lit("not-a-uuid"))
    errors = service.request_errors(question, F.col("turn") % 6, _picked(n, "1039", "1110", None, "1109"), _picked(n, "standard_body", "nowhere", None), (n % 53).cast("int"), request_id)
    return c.select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query
def q32_image_validation(spark, d):
    doc = corpus.table(spark, d, "documents")
    data = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")  # one line
    broken = F.when(F.col("doc_id") % 5 == 1, F.concat(data, F.lit("\n"))).when(F.col("doc_id") % 5 == 2, F.lit("")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("*"), data)).otherwise(data)
    mime = _picked(F.col("doc_id"), *["image/png", "image/jpeg", "image/webp", "image/gif", "image/bmp", "text/plain"])
    rows = doc.select("doc_id", mime.alias("mime"), broken.alias("data"))
    errors = service.image_errors(F.col("mime"), F.col("data"), F.lit("image"))
    return rows.select("doc_id", F.array_join(errors, ",").alias("errors"), F.md5(F.encode(service.data_url(F.col("mime"), F.col("data")), "UTF-8")).alias("url_md5"))


@query
def q33_image_query(spark, d):
    c = corpus.table(spark, d, "conversations")
    q = service.image_query(F.concat(F.lit(" "), F.repeat("text", 30)), F.split("text", " "))
    return c.select("conv_id", "turn", F.length(q["semantic_query"]).cast("long").alias("n_semantic"), F.md5(F.encode(q["semantic_query"], "UTF-8")).alias("semantic_md5"), q["keyword_query"].alias("keyword_query"), q["invalid"].alias("invalid"))


@query
def q34_query_fallback(spark, d):
    c = corpus.table(spark, d, "conversations")
    q = service.query_fallback(F.concat(F.lit(" "), "text"), _picked(F.col("turn"), "", None, "  ", "semantic"), _picked(F.col("conv_id"), "", None, "  ", "key words"))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in q.items()])


@query
def q35_rate_limit(spark, d):
    return admission.rate_limit(corpus.table(spark, d, "events"), RATE_WINDOW, RATE_LIMIT).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "allowed")


def _trace(spark, d):
    return admission.job_trace(corpus.job_events(spark, d), JOB_TTL)


@query
def q36_idempotent_jobs(spark, d):
    rows = _trace(spark, d).filter("op = 'create'")
    return rows.select(F.col("id").alias("event_id"), F.col("key").alias("request_id"), (F.col("outcome") == "created").alias("created"), F.sha2(F.concat_ws("-", "key", "job_no"), 256).alias("job_id"))


@query
def q37_job_ttl_state(spark, d):
    return _trace(spark, d).select(F.col("id").alias("event_id"), F.col("key").alias("request_id"), "op", "outcome", "job_no")


@query
def q38_chat_title(spark, d):
    c = corpus.table(spark, d, "conversations")
    text = F.when(F.col("turn") % 7 == 6, F.lit("")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.chat_title(text).alias("title"))


@query
def q39_history_cap(spark, d):
    """Each client's 30 most recently updated chats, newest first."""
    from pyspark.sql import Window

    c = corpus.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.min_by("text", "turn").alias("first_text"))
    rows = c.withColumn("client", F.col("conv_id") % 3).withColumn("updated", F.col("turns") * 1000 + F.col("conv_id") % 1000)
    pos = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("updated"), "conv_id")).cast("long")
    return rows.withColumn("pos", pos).filter("pos <= 30").select("client", "pos", "conv_id", T.chat_title(F.col("first_text")).alias("title"))


@query
def q40_lucene_escape(spark, d):
    p = corpus.table(spark, d, "pages")
    return p.select("page_id", T.escape_query(F.col("url")).alias("url"), F.md5(F.encode(T.escape_query(F.col("html")), "UTF-8")).alias("html_md5"))


STANDARD_FORMS = (" KIFRS{} ", "제{}호", "K-IFRS 제 {} 호", "k ifrs{}", "{}", "IFRS {}", "", None, "{}9", "１１０９")


@query
def q41_standard_id(spark, d):
    doc = corpus.table(spark, d, "documents")
    digits = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    form = F.lit(None).cast("string")
    for i, x in enumerate(STANDARD_FORMS):
        if x is not None:
            before, _, after = x.partition("{}")
            value = F.concat(F.lit(before), digits, F.lit(after)) if "{}" in x else F.lit(x)
            form = F.when(F.col("doc_id") % len(STANDARD_FORMS) == i, value).otherwise(form)
    return doc.select("doc_id", T.standard_id(form).alias("standard_id"), T.standard_id_invalid(form).alias("invalid"))


PHRASES = ("금융상품의 인식과 측정", "복합금융상품 분류 K", "위험회피 회계 1109", "자본", "파생상품과 내재파생상품")


@query
def q42_cjk_bigrams(spark, d):
    doc = corpus.table(spark, d, "documents")
    rows = doc.select("doc_id", T.analyze(F.concat(_picked(F.col("doc_id"), *PHRASES), F.lit(" "), F.coalesce("text", F.lit("")))).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.encode(F.array_join("tokens", "|"), "UTF-8")).alias("tokens_md5"))


@query
def q43_header_split(spark, d):
    e = corpus.table(spark, d, "events")
    header = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 , 10.9.9.9")))
    origins = F.concat(F.lit(" http://a,, http://"), F.col("event_type"), F.lit(" , "))
    return e.select("event_id", T.client_ip(header, F.when(F.col("event_id") % 8 != 0, F.lit("127.0.0.1")), True).alias("ip"), F.array_join(T.split_list(origins), "|").alias("origins"))


@query
def q44_strip_tag(spark, d):
    c = corpus.chunks(spark, d)
    return c.select("chunk_id", F.md5(F.encode(T.strip_tag(F.col("contextualized_text")), "UTF-8")).alias("statement_md5"))


@plan_query
def q45_answer_text(r):
    a = evidence.answer(r.items)
    kind = F.when(F.col("qid") % 5 == 0, "insufficient").when(F.col("qid") % 5 == 1, "system_error").otherwise("answered")
    return a.select("qid", service.answer_text(kind, F.col("conclusion"), F.col("reasoning"), F.col("evidence")).alias("answer_text"))


@query
def q46_request_json(spark, d):
    """Request documents of several forms, read with their defaults and errors."""
    c = corpus.table(spark, d, "conversations")
    asked, n = evidence.json_string(F.col("text")), F.col("conv_id") + F.col("turn")
    forms = [
        F.concat(F.lit('{"question": '), asked, F.lit(', "top_k": 5}')), F.concat(F.lit('{"question": '), asked, F.lit(', "extra": 1}')), F.concat(F.lit('{"question": '), asked), F.lit("[1]"),
        F.concat(F.lit('{"question": '), asked, F.lit(', "top_k": 99, "standard_id": "1110"}')), F.lit('{"images": [{"mime_type": "image/png", "data": "YQ==", "x": 1}]}'), F.lit('{"question": "  ", "top_k": "a"}'),
    ]
    body = F.lit(None).cast("string")
    for i, x in enumerate(forms):
        body = F.when(n % len(forms) == i, x).otherwise(body)
    got = contract.read_requests(c.select("conv_id", "turn", body.alias("body")))
    return got.select("conv_id", "turn", "question", F.size("images").cast("long").alias("n_images"), F.col("top_k").cast("long").alias("top_k"), "debug", F.array_join("errors", ",").alias("errors"))


@plan_query
def q47_response_json(r):
    """The response document, read back; odd questions ask for diagnostics."""
    body = contract.public_response(evidence.answer(r.items), r.metrics, r.questions, F.col("qid") % 2 == 1)
    at = lambda path: F.get_json_object("body", f"$.{path}")
    return body.select(
        "qid", F.array_join(F.json_object_keys("body"), ",").alias("keys"), at("status").alias("status"), at("reason").alias("reason"), at("conclusion").alias("conclusion"),
        at("reasoning[0]").alias("first_step"), at("evidence[0].citation").alias("first_citation"), at("evidence[0].evidence_id").alias("first_evidence"),
        at("diagnostics.retrieval.seed_count").cast("long").alias("seed_count"), at("diagnostics.retrieval.filters.standard_id").alias("standard_id"), at("diagnostics.reason").alias("diagnostic_reason"),
    )


@plan_query
def q48_score_event(r):
    """The score log's documents, read back."""
    events = contract.score_events(r.questions, r.dense, r.sparse, channels.top_fused(r.fused, r.hybrid.seed_top_k), (r.hybrid.dense_min_score, r.hybrid.sparse_min_score))
    at = lambda path: F.get_json_object("event", f"$.{path}")
    return events.select(
        "qid", F.array_join(F.json_object_keys("event"), ",").alias("keys"), at("question_hash").alias("question_hash"), at("filters.standard_id").alias("standard_id"), at("filters.zone").alias("zone"),
        at("thresholds.dense").cast("double").alias("dense_floor"), at("thresholds.sparse").cast("double").alias("sparse_floor"),
        at("dense[0].chunk_id").alias("best_dense"), at("dense[0].passed").cast("boolean").alias("best_dense_passed"), at("sparse[0].chunk_id").alias("best_sparse"), at("selected_chunk_ids").alias("selected"),
    )


@plan_query
def q49_hit_payload(r):
    """Dense hits with the columns of their chunks that travel with them."""
    rows = contract.with_payload(r.dense, r.chunks)
    digest = lambda c: F.md5(F.encode(F.col(c), "UTF-8")).alias(f"{c}_md5")
    return rows.select("qid", "chunk_id", "rank", "standard_id", "zone", "chunk_type", digest("text"), digest("contextualized_text"), "citation_label", "pdf_page_start", "pdf_page_end", "search_priority")


@query
def q50_job_quota(spark, d):
    """Creates of clients under a quota; every third has no request id."""
    e = corpus.table(spark, d, "events")
    request = F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", "user_id", "event_type"))
    rows = e.select((F.col("user_id") % CLIENTS).alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), request.alias("request"))
    return admission.admitted_jobs(rows, RATE_WINDOW, 3 * RATE_LIMIT, JOB_TTL).select(F.col("id").alias("event_id"), F.col("key").alias("client"), "outcome")


@query
def q51_stored_history(spark, d):
    """Stored chat lists, some of other shapes, read back."""
    c = corpus.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count("*").alias("n"))
    title, id_ = evidence.json_string(T.chat_title(F.col("t"))), F.col("conv_id").cast("string")
    whole = F.concat(F.lit('{"id": "c'), id_, F.lit('", "title": '), title, F.lit(', "messages": [{"role": "user"}, 2]}'))
    kind = F.col("conv_id") % 4
    value = F.when(kind == 1, F.concat(F.lit('[{"id": "c'), id_, F.lit('"}, '), whole, F.lit("]"))).when(kind == 2, whole).when(kind == 3, F.concat(F.lit("[7, "), whole, F.lit(", "), whole, F.lit("]"))).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    got = contract.stored_history(c.select("conv_id", value.alias("value")))
    return got.select("conv_id", F.col("pos").cast("long").alias("pos"), "id", "title", F.col("n_messages").cast("long").alias("n_messages"))
