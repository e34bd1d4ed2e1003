"""Rules around a question: gate, reasons, error mapping, request and image validation, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import or_else, strip, strip_tag
from quillstream.schemas import IMAGE_TYPES, STANDARD_IDS, ZONES

# Reasons, texts and limits of the service contract.
INSUFFICIENT_REASONS = ("self_declined", "no_evidence_found", "deterministic_failed", "semantic_insufficient", "no_supported_evidence", "generation_failed")
SYSTEM_ERROR_REASONS = ("semantic_error", "semantic_not_run")
FILTERED_CONCLUSION = "근거 부족: 질문과 충분히 관련된 기준서 문단을 찾지 못했습니다."
EMPTY_CONCLUSION = "근거 부족: 질문과 관련된 기준서 문단을 찾지 못했습니다."
FILTERED_REASONING = "근거 부족: 검색 후보가 관련성 기준을 충족하지 못했습니다."
EMPTY_REASONING = "근거 부족: 검색 결과가 없어 답변할 수 없습니다."
UNAVAILABLE_DETAIL = "질의 처리 서비스에 일시적으로 연결할 수 없습니다."
INTERNAL_DETAIL = "질의 처리 중 내부 오류가 발생했습니다."
REJECTED_DETAIL = "요청 값을 처리할 수 없습니다."
BUSY_GUIDANCE = "요청이 많습니다. 잠시 후 다시 시도해 주세요."
INPUT_GUIDANCE = "질문이나 첨부 이미지를 다시 확인해 주세요."
UNRELIABLE_TEXT = "현재 정보만으로는 신뢰성 있는 답변을 제공하기 어렵습니다."
ERROR_TEXT = "일시적인 오류가 발생했습니다."
NO_EVIDENCE_TEXT = "표시할 수 있는 검증 근거가 없습니다."
UNKNOWN_SOURCE = "출처 정보 없음"
ANSWER_HEAD, REASON_HEAD, REFERENCE_HEAD = "답변", "근거", "참조"
QUESTION_CHARS, MAX_TOP_K, MAX_IMAGES, NAME_CHARS, IMAGE_CHARS, IMAGE_BYTES, QUERY_CHARS = 2000, 50, 4, 160, 10_000_000, 5 * 1024 * 1024, 6000
UUID = r"(?i)^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def gate(result_count: Column, filtered_all: Column) -> dict[str, Column]:
    """status, reason, and the fixed texts of an empty retrieval (null where there are results)."""
    some, filtered = result_count > 0, F.coalesce(filtered_all, F.lit(False))
    pick = lambda a, b: F.when(~some & filtered, a).when(~some, b)
    return {
        "status": F.when(some, "answered").otherwise("insufficient"),
        "reason": F.when(some, "evidence_available").when(filtered, "no_supported_evidence").otherwise("no_evidence_found"),
        "conclusion": pick(FILTERED_CONCLUSION, EMPTY_CONCLUSION),
        "reasoning": pick(FILTERED_REASONING, EMPTY_REASONING),
    }


def result_kind(status: Column, reason: Column) -> Column:
    """How a client shows an answer; only the older reason ``sufficient`` counts as answered there."""
    s, r = F.coalesce(status, F.lit("")), F.coalesce(reason, F.lit(""))
    return (
        F.when((s == "answered") & (r == "sufficient"), "answered")
        .when(r.isin(*SYSTEM_ERROR_REASONS), "system_error")
        .when(s.isin("insufficient", "generation_failed") & r.isin(*INSUFFICIENT_REASONS), "insufficient")
        .otherwise("system_error")
    )


def fallback_reason(status: Column, sufficiency: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(s == "answered", "evidence_available").when(s == "generation_failed", "generation_failed")
        .when(F.length(sufficiency) > 0, sufficiency).when(F.length(s) > 0, s).otherwise("unknown")
    )


def http_status(error_class: Column, module: Column) -> Column:
    """422 for rejected values, 503 where a remote service failed, 500 for the rest; null without an error."""
    remote = error_class.isin("ConnectionError", "TimeoutError", "PipelineUnavailable") | F.split_part(F.coalesce(module, F.lit("")), F.lit("."), F.lit(1)).isin("neo4j", "openai")
    return F.when(error_class.isNull(), F.lit(None).cast("int")).when(error_class == "ValueError", 422).when(remote, 503).otherwise(500)


def error_detail(status: Column) -> Column:
    return F.when(status == 422, REJECTED_DETAIL).when(status == 503, UNAVAILABLE_DETAIL).when(status == 500, INTERNAL_DETAIL)


def error_guidance(status: Column) -> Column:
    return F.when(status == 429, BUSY_GUIDANCE).when(status == 422, INPUT_GUIDANCE)


def is_base64(data: Column) -> Column:
    """Whether a text is strict base64 (as BASE64 says): its alphabet, then padding, to a multiple of four."""
    return (F.length(data) % 4 == 0) & data.rlike(r"^[A-Za-z0-9+/]*+={0,2}\z")


def image_errors(mime: Column, data: Column, name: Column) -> Column:
    """Names of broken rules of one image; decoding is strict (no blanks or line ends inside), and only its size is needed."""
    decoded = F.when(is_base64(data), F.length(data) / 4 * 3 - (F.length(data) - F.length(F.rtrim(data, F.lit("=")))))
    rule = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), what)
    return F.array_compact(F.array(
        rule(~mime.isin(*IMAGE_TYPES), "mime_type"),
        F.when(F.length(name) > NAME_CHARS, "name"),
        rule((F.length(data) < 1) | (F.length(data) > IMAGE_CHARS), "data_length"),
        rule(~is_base64(data), "base64"),
        F.when(decoded > IMAGE_BYTES, "too_large"),
    ))


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), data)


def request_errors(question: Column, n_images: Column, standard: Column, zone: Column, top_k: Column, request_id: Column) -> Column:
    """Names of broken rules of a request; the length limit applies before stripping."""
    q = F.coalesce(question, F.lit(""))
    return F.array_compact(F.array(
        F.when(F.length(q) > QUESTION_CHARS, "question_length"),
        F.when(n_images > MAX_IMAGES, "images"),
        F.when(~standard.isin(*STANDARD_IDS), "standard_id"),
        F.when(~zone.isin(*ZONES), "zone"),
        F.when((top_k < 1) | (top_k > MAX_TOP_K), "top_k"),
        F.when(~request_id.rlike(UUID), "request_id"),
        F.when((F.length(strip(q)) == 0) & (F.coalesce(n_images, F.lit(0)) == 0), "question_or_image"),
    ))


def image_query(semantic: Column, keywords: Column) -> dict[str, Column]:
    """The cleaned query pair of an image analysis: at most 6000 code points, and distinct keywords joined by blanks."""
    clean = F.array_distinct(F.filter(F.transform(keywords, strip), lambda k: F.length(k) > 0))
    sem = strip(F.coalesce(semantic, F.lit("")))
    return {
        "semantic_query": F.substring(sem, 1, QUERY_CHARS),
        "keyword_query": F.array_join(clean, " "),
        "invalid": (F.length(sem) == 0) | (F.size(clean) <= 0),
    }


def query_fallback(question: Column, semantic: Column, sparse: Column) -> dict[str, Column]:
    """Dense and sparse queries: empty falls back, blank doesn't and is an error."""
    asked = strip(F.coalesce(question, F.lit("")))
    dense = strip(or_else(semantic, asked))
    keyword = strip(or_else(sparse, dense))
    return {"dense_query": dense, "sparse_query": keyword, "invalid": (F.length(dense) == 0) | (F.length(keyword) == 0)}


def answer_text(kind: Column, conclusion: Column, reasoning: Column, evidence: Column) -> Column:
    """Plain text of an answer; ``evidence`` is an array of structs with evidence_id, citation and statement."""
    numbered = F.transform(reasoning, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    cited = F.flatten(F.transform(evidence, lambda e: F.array(
        F.concat(F.lit("["), or_else(e["evidence_id"], F.lit(REASON_HEAD)), F.lit("] "), or_else(e["citation"], F.lit(UNKNOWN_SOURCE))),
        strip_tag(e["statement"]),
    )))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.lit(ANSWER_HEAD), F.coalesce(conclusion, F.lit(""))),
        F.when(F.size(reasoning) > 0, F.concat(F.array(F.lit(""), F.lit(REASON_HEAD)), numbered)).otherwise(none),
        F.array(F.lit(""), F.lit(REFERENCE_HEAD)),
        F.when(F.size(evidence) > 0, cited).otherwise(F.array(F.lit(NO_EVIDENCE_TEXT))),
    )
    return F.when(kind == "insufficient", UNRELIABLE_TEXT).when(kind == "system_error", ERROR_TEXT).otherwise(F.array_join(parts, "\n"))
