"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

from quillstream.functions.text import STOP_WORDS
from quillstream.operators import service
from quillstream.plans import queries as Q
from quillstream.plans.retrieval import ANSWER, HYBRID, RETRIEVAL
from quillstream.schemas import IMAGE_TYPES, STANDARD_IDS, ZONES


def _s(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def _in(values) -> str:
    return "(" + ", ".join(map(_s, values)) + ")"


def _pick(number: str, *values) -> str:
    return f"({_list(values)})[({number}) % {len(values)} + 1]"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND w NOT IN " + _in(STOP_WORDS) + ")"
H = HYBRID

CHUNKS = f"""
chunks AS (
  SELECT d.doc_id, 'D' || lpad(d.doc_id::VARCHAR, 7, '0') AS chunk_id, d.text,
    CASE d.lang WHEN 'de' THEN '1032' WHEN 'en' THEN '1039' WHEN 'es' THEN '1107' WHEN 'fr' THEN '1109' END AS standard_id,
    ({_list(ZONES)})[TRY_CAST(substr(d.source, 4) AS INTEGER) % {len(ZONES)} + 1] AS zone,
    CASE WHEN d.doc_id % 5 = 1 THEN ' ' WHEN d.doc_id % 5 > 1 THEN '문단 ' || d.doc_id END AS citation_label,
    (d.doc_id % 300 + 1)::INTEGER AS pdf_page_start, (d.doc_id % 300 + 2)::INTEGER AS pdf_page_end,
    CASE WHEN d.doc_id % 11 <> 0 THEN (d.doc_id % 3)::INTEGER END AS part_index,
    CASE WHEN d.doc_id % 4 <> 0 THEN '[' || CASE d.lang WHEN 'de' THEN '1032' WHEN 'en' THEN '1039' WHEN 'es' THEN '1107' WHEN 'fr' THEN '1109' END || ']' || chr(10) || d.text END AS contextualized_text,
    l.quality = 1 AS searchable, l.toxic = 1 AS inactive
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

PLAN = (
    "WITH" + CHUNKS + f""",
indexed AS (SELECT *, CASE WHEN length(contextualized_text) > 0 THEN contextualized_text ELSE text END AS body FROM chunks),
questions AS (
  SELECT b.item_id AS qid, b.text AS question, e.embedding::DOUBLE[] AS qv,
    CASE WHEN b.item_id % 3 = 0 THEN '1039' END AS want_standard,
    CASE WHEN b.item_id % 4 = 1 THEN ({_list(ZONES)})[b.item_id % {len(ZONES)} + 1] END AS want_zone, b.item_id % 15 + 1 AS top_k
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
vec AS (SELECT 'D' || lpad(vec_id::VARCHAR, 7, '0') AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
dense_scored AS (SELECT qid, chunk_id, round((1 + list_cosine_similarity(qv, v)) / 2, 9) AS score FROM questions JOIN vec ON qv IS NOT NULL),
dense_raw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dense_scored QUALIFY rank <= {H.dense_top_k}),
tok AS (SELECT chunk_id, {WORDS.format('body')} AS t FROM indexed),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({WORDS.format('question')}) AS term FROM questions) GROUP BY ALL),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sparse_scored AS (
  SELECT qid, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))), 9) AS score
  FROM qt JOIN df USING (term) JOIN post USING (term) CROSS JOIN stats GROUP BY qid, chunk_id),
sparse_raw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse_scored QUALIFY rank <= {H.sparse_top_k}),
ok AS (SELECT * FROM chunks WHERE coalesce(searchable, false) AND NOT coalesce(inactive, false)),
dense_f AS (SELECT r.qid, r.chunk_id, r.score, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.chunk_id) AS rank FROM dense_raw r JOIN ok USING (chunk_id)),
sparse_f AS (SELECT r.qid, r.chunk_id, r.score, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.chunk_id) AS rank FROM sparse_raw r JOIN ok USING (chunk_id)),
dense_p AS (SELECT r.qid, r.chunk_id, r.score, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.chunk_id) AS rank FROM dense_raw r JOIN ok c USING (chunk_id) JOIN questions q ON q.qid = r.qid WHERE (want_standard IS NULL OR want_standard = c.standard_id) AND (want_zone IS NULL OR want_zone = c.zone)),
sparse_p AS (SELECT r.qid, r.chunk_id, r.score, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.chunk_id) AS rank FROM sparse_raw r JOIN ok c USING (chunk_id) JOIN questions q ON q.qid = r.qid WHERE (want_standard IS NULL OR want_standard = c.standard_id) AND (want_zone IS NULL OR want_zone = c.zone)),
dense_t AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dense_f WHERE NOT isnan(score) AND score >= {H.dense_min_score}),
sparse_t AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse_f WHERE NOT isnan(score) AND score >= {H.sparse_min_score}),
pairs AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score
  FROM dense_t d FULL JOIN sparse_t s ON d.qid = s.qid AND d.chunk_id = s.chunk_id),
fused AS (SELECT *, coalesce(1e0 / ({H.rrf_k} + dense_rank), 0) + coalesce(1e0 / ({H.rrf_k} + sparse_rank), 0) AS rrf_score FROM pairs),
fused_pos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, chunk_id) AS pos FROM fused),
top AS (SELECT f.* FROM fused_pos f JOIN questions q USING (qid) WHERE pos <= least({H.seed_top_k}, q.top_k)),
seeds AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS seed_rank FROM top),
derived AS (
  SELECT 'D' || lpad(doc_id::VARCHAR, 7, '0') AS chunk_id, doc_id // 3 AS p FROM documents
  UNION ALL SELECT 'D' || lpad(doc_id::VARCHAR, 7, '0'), doc_id // 3 + 1 FROM documents WHERE doc_id % 10 = 0),
reached AS (SELECT s.qid, b.chunk_id, min(s.seed_rank) AS seed_rank FROM seeds s JOIN derived a USING (chunk_id) JOIN derived b ON a.p = b.p GROUP BY ALL),
siblings AS (
  SELECT r.qid, r.chunk_id, r.seed_rank, c.part_index FROM reached r JOIN chunks c USING (chunk_id)
  WHERE coalesce(c.searchable, false) AND NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = r.qid AND s.chunk_id = r.chunk_id)
  QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY r.seed_rank, c.part_index NULLS LAST, r.chunk_id) <= {RETRIEVAL.max_siblings}),
both_kinds AS (
  SELECT qid, chunk_id, seed_rank, 'hybrid' AS candidate_source, 0 AS kind, NULL::INTEGER AS part_index FROM seeds
  UNION ALL SELECT qid, chunk_id, seed_rank, 'sibling', 1, part_index FROM siblings),
results AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seed_rank, kind, part_index NULLS LAST, chunk_id) AS pos, chunk_id, candidate_source, seed_rank FROM both_kinds),
raw_n AS (SELECT qid, count(DISTINCT chunk_id) AS n FROM (SELECT qid, chunk_id FROM dense_f UNION ALL SELECT qid, chunk_id FROM sparse_f) GROUP BY qid),
top_n AS (SELECT qid, count(*) AS n FROM top GROUP BY qid),
res_n AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE candidate_source = 'sibling') AS sib FROM results GROUP BY qid),
metrics AS (
  SELECT q.qid, coalesce(a.n, 0) AS raw_candidate_count, coalesce(b.n, 0) AS seed_count, coalesce(c.sib, 0) AS sibling_count, coalesce(c.n, 0) AS result_count,
    coalesce(a.n, 0) > 0 AND coalesce(b.n, 0) = 0 AS threshold_filtered_all
  FROM questions q LEFT JOIN raw_n a USING (qid) LEFT JOIN top_n b USING (qid) LEFT JOIN res_n c USING (qid)),
candidates AS (
  SELECT r.qid, r.pos, r.chunk_id AS source_id, {STRIP.format("coalesce(CASE WHEN length(c.contextualized_text) > 0 THEN c.contextualized_text ELSE c.text END, '')")} AS body,
    CASE WHEN {STRIP.format("coalesce(c.citation_label, '')")} <> '' THEN {STRIP.format("c.citation_label")}
         WHEN coalesce(c.standard_id, '') <> '' THEN 'K-IFRS 제' || c.standard_id || '호 (' || r.chunk_id || ')' ELSE r.chunk_id END AS citation,
    c.pdf_page_start, c.pdf_page_end, r.candidate_source
  FROM results r JOIN chunks c USING (chunk_id) WHERE r.pos <= {ANSWER.max_candidates}),
capped AS (SELECT *, least(length(body), {ANSWER.max_candidate_chars}) AS a FROM candidates),
budget AS (SELECT *, greatest(0, least(a, {ANSWER.max_context_chars} - coalesce(sum(a) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take FROM capped),
items AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS evidence_no, 'E' || row_number() OVER (PARTITION BY qid ORDER BY pos) AS evidence_id,
    source_id, citation, substr(body, 1, take) AS statement, pdf_page_start, pdf_page_end, candidate_source FROM budget WHERE take > 0),
output AS (
  SELECT qid, arg_min(citation, evidence_no) || ' [E1]' AS conclusion, ['step [E' || max(evidence_no) || ']', 'done'] AS reasoning,
    ['E9999', 'E' || max(evidence_no), 'E1'] AS declared FROM items GROUP BY qid),
ids AS (SELECT qid, list_concat(declared, list_concat(regexp_extract_all(conclusion, '\\[(E\\d+)\\]', 1), flatten(list_transform(reasoning, lambda x: regexp_extract_all(x, '\\[(E\\d+)\\]', 1))))) AS l FROM output),
firsts AS (SELECT qid, id AS evidence_id, min(i) AS i FROM (SELECT qid, unnest(l) AS id, generate_subscripts(l, 1) AS i FROM ids) GROUP BY ALL),
cited AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS cite_no, evidence_id FROM firsts)
"""
)

GATE = f"""
  CASE WHEN result_count > 0 THEN 'answered' ELSE 'insufficient' END AS status,
  CASE WHEN result_count > 0 THEN 'evidence_available' WHEN threshold_filtered_all THEN 'no_supported_evidence' ELSE 'no_evidence_found' END AS reason,
  CASE WHEN result_count > 0 THEN NULL WHEN threshold_filtered_all THEN {_s(service.FILTERED_CONCLUSION)} ELSE {_s(service.EMPTY_CONCLUSION)} END AS conclusion"""

CALLS = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'get' WHEN 'click' THEN 'delete' END"
TRACE = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, {CALLS} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
live AS (
  SELECT e.*, CAST(NULL AS VARCHAR) AS prev, CAST(0 AS BIGINT) AS prev_at, CAST(0 AS BIGINT) AS prev_no FROM e WHERE i = 1),
steps AS (
  SELECT user_id, event_id, us, op, i,
    CASE WHEN op = 'create' THEN 'pending' END AS status, CASE WHEN op = 'create' THEN us ELSE 0 END AS at, CASE WHEN op = 'create' THEN 1::BIGINT ELSE 0 END AS no,
    CASE WHEN op = 'create' THEN 'created' ELSE 'none' END AS outcome
  FROM live
  UNION ALL
  SELECT e.user_id, e.event_id, e.us, e.op, e.i,
    CASE WHEN e.op = 'create' THEN CASE WHEN s.status IS NULL OR e.us - s.at > {Q.JOB_TTL}000000 THEN 'pending' ELSE s.status END
         WHEN e.op = 'get' THEN CASE WHEN e.us - s.at > {Q.JOB_TTL}000000 THEN NULL ELSE s.status END
         WHEN e.op = 'finish' THEN CASE WHEN s.status IS NOT NULL THEN 'complete' END
         WHEN e.op = 'fail' THEN CASE WHEN s.status IS NOT NULL THEN 'error' END END,
    CASE WHEN e.op = 'create' AND (s.status IS NULL OR e.us - s.at > {Q.JOB_TTL}000000) THEN e.us
         WHEN e.op IN ('finish', 'fail') AND s.status IS NOT NULL THEN e.us ELSE s.at END,
    CASE WHEN e.op = 'create' AND (s.status IS NULL OR e.us - s.at > {Q.JOB_TTL}000000) THEN s.no + 1 ELSE s.no END,
    CASE WHEN e.op = 'create' THEN CASE WHEN s.status IS NULL OR e.us - s.at > {Q.JOB_TTL}000000 THEN 'created' ELSE 'existing' END
         WHEN e.op = 'get' THEN CASE WHEN s.status IS NULL OR e.us - s.at > {Q.JOB_TTL}000000 THEN 'none' ELSE s.status END
         ELSE CASE WHEN s.status IS NULL THEN 'none' ELSE 'done' END END
  FROM steps s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
"""

TITLE = "CASE WHEN length({0}) > 32 THEN substr({0}, 1, 32) || '…' ELSE {0} END"


def _title(text: str) -> str:
    clean = STRIP.format(rf"regexp_replace(CASE WHEN length({text}) > 0 THEN {text} ELSE '이미지 분석 요청' END, '\s+', ' ', 'g')")
    return TITLE.format(clean)


SPECIAL = r"(&&|\|\||[+\-!(){}\[\]^\"~*?:\\/])"
BASE64 = service.BASE64.removeprefix("^").removesuffix(r"\z").replace("?:", "")


def _form(i: int, x: str | None) -> str:
    before, hole, after = (x or "").partition("{}")
    value = "NULL" if x is None else (f"{_s(before)} || digits || {_s(after)}" if hole else _s(x))
    return f"WHEN {i} THEN {value}"


ORACLES: dict[str, str] = {
    "q01_dense_topk": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM dense_raw",
    "q02_dense_postfilter": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM dense_f",
    "q03_dense_param_filter": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM dense_p",
    "q04_bm25_topk": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM sparse_raw",
    "q05_bm25_postfilter": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM sparse_f",
    "q06_bm25_param_filter": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM sparse_p",
    "q07_channel_threshold": PLAN + "SELECT qid, chunk_id, rank, round(score, 6) AS score, 'dense' AS channel FROM dense_t UNION ALL SELECT qid, chunk_id, rank, round(score, 6), 'sparse' FROM sparse_t",
    "q08_rrf_fuse": PLAN + "SELECT qid, chunk_id, dense_rank, round(dense_score, 6) AS dense_score, sparse_rank, round(sparse_score, 6) AS sparse_score, round(rrf_score, 9) AS rrf_score, concat_ws('+', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END) AS channels FROM fused",
    "q09_rrf_weighted_topk": PLAN + f", w AS (SELECT qid, chunk_id, coalesce(2e0 / ({H.rrf_k} + dense_rank), 0) + coalesce(1e0 / ({H.rrf_k} + sparse_rank), 0) AS x FROM pairs) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY x DESC, chunk_id) AS pos, chunk_id, round(x, 9) AS rrf_score FROM w QUALIFY pos <= 10",
    "q10_seed_limit": PLAN + "SELECT qid, chunk_id, seed_rank FROM seeds",
    "q11_score_log": PLAN + f", log AS (SELECT qid, 'dense' AS channel, chunk_id, rank, score, NOT isnan(score) AND score >= {H.dense_min_score} AS passed FROM dense_f UNION ALL SELECT qid, 'sparse', chunk_id, rank, score, NOT isnan(score) AND score >= {H.sparse_min_score} FROM sparse_f) SELECT l.qid, sha256(q.question) AS question_hash, l.channel, l.chunk_id, l.rank, round(l.score, 6) AS score, l.passed, f.pos IS NOT NULL AS selected FROM log l JOIN questions q USING (qid) LEFT JOIN fused_pos f ON f.qid = l.qid AND f.chunk_id = l.chunk_id AND f.pos <= {H.seed_top_k}",
    "q12_siblings": PLAN + "SELECT qid, chunk_id, seed_rank, part_index FROM siblings",
    "q13_interleave": PLAN + "SELECT qid, pos, chunk_id, candidate_source, seed_rank FROM results",
    "q14_retrieval_metrics": PLAN + "SELECT * FROM metrics",
    "q15_citation": "WITH" + CHUNKS + f""", p AS (
      SELECT chunk_id, {STRIP.format("coalesce(CASE WHEN length(citation_label) > 0 THEN citation_label WHEN doc_id % 10 = 0 THEN ' 부록 A ' END, '')")} AS direct,
        CASE WHEN doc_id % 7 <> 0 THEN standard_id END AS std, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 50)::VARCHAR END AS par FROM chunks)
      SELECT chunk_id, CASE WHEN direct <> '' THEN direct WHEN std IS NOT NULL AND par IS NOT NULL THEN 'K-IFRS 제' || std || '호 ' || par WHEN std IS NOT NULL THEN 'K-IFRS 제' || std || '호 (' || chunk_id || ')' ELSE chunk_id END AS citation FROM p""",
    "q16_candidate_slice": PLAN + "SELECT qid, pos, source_id, length(body) AS n_chars, citation, NULL::VARCHAR AS error FROM candidates",
    "q17_evidence_budget": PLAN + "SELECT qid, evidence_id, source_id, length(statement) AS n_chars, md5(statement) AS statement_md5 FROM items",
    "q18_evidence_metadata": PLAN + "SELECT qid, evidence_id, citation, pdf_page_start, pdf_page_end, candidate_source FROM items",
    "q20_cited_ids": PLAN + "SELECT qid, cite_no, evidence_id FROM cited",
    "q21_citation_join": PLAN + "SELECT c.qid, c.cite_no, c.evidence_id, i.citation, md5(i.statement) AS statement_md5, i.candidate_source FROM cited c JOIN items i ON i.qid = c.qid AND i.evidence_id = c.evidence_id",
    "q22_payload_parse": f"""WITH p AS (SELECT conv_id || '-' || turn AS qid, (conv_id + turn) % 5 AS kind, text, role FROM conversations)
      SELECT qid, CASE WHEN kind IN (0, 4) THEN {STRIP.format('text')} END AS conclusion, CASE WHEN kind IN (0, 4) THEN {STRIP.format('role')} || '|x' END AS reasoning,
        CASE WHEN kind IN (0, 4) THEN 'E1|E2' END AS declared, CASE kind WHEN 1 THEN 'empty output' WHEN 2 THEN 'not an object' WHEN 3 THEN 'empty conclusion' END AS error FROM p""",
    "q25_qa_gate": PLAN + f"SELECT qid, {GATE}, CASE WHEN result_count > 0 THEN NULL WHEN threshold_filtered_all THEN {_s(service.FILTERED_REASONING)} ELSE {_s(service.EMPTY_REASONING)} END AS reasoning FROM metrics",
    "q26_result_kind": f"""WITH p AS (SELECT event_id, coalesce({_pick('event_id', *Q.STATUSES)}, '') AS s, coalesce({_pick('event_id // 5', *Q.REASONS)}, '') AS r FROM events)
      SELECT event_id, CASE WHEN s = 'answered' AND r = 'sufficient' THEN 'answered' WHEN r IN {_in(service.SYSTEM_ERROR_REASONS)} THEN 'system_error'
        WHEN s IN ('insufficient', 'generation_failed') AND r IN {_in(service.INSUFFICIENT_REASONS)} THEN 'insufficient' ELSE 'system_error' END AS kind FROM p""",
    "q27_reason_fallback": f"""WITH p AS (SELECT event_id, coalesce({_pick('event_id', *Q.STATUSES, '')}, '') AS s, {_pick('event_id // 6', 'partial', '', None)} AS r FROM events)
      SELECT event_id, CASE WHEN s = 'answered' THEN 'evidence_available' WHEN s = 'generation_failed' THEN s WHEN r <> '' THEN r WHEN s <> '' THEN s ELSE 'unknown' END AS reason FROM p""",
    "q28_error_map": f"""WITH p AS (SELECT event_id, {_pick('event_id', *Q.ERRORS)} AS c, split_part(coalesce({_pick('event_id // 7', *Q.MODULES)}, ''), '.', 1) AS m FROM events),
      h AS (SELECT event_id, CASE WHEN event_id % 35 = 0 THEN 429 WHEN c IS NULL THEN NULL WHEN c = 'ValueError' THEN 422 WHEN c IN ('ConnectionError', 'TimeoutError', 'PipelineUnavailable') OR m IN ('neo4j', 'openai') THEN 503 ELSE 500 END::BIGINT AS http_status FROM p)
      SELECT event_id, http_status, CASE http_status WHEN 422 THEN {_s(service.REJECTED_DETAIL)} WHEN 503 THEN {_s(service.UNAVAILABLE_DETAIL)} WHEN 500 THEN {_s(service.INTERNAL_DETAIL)} END AS detail,
        CASE http_status WHEN 429 THEN {_s(service.BUSY_GUIDANCE)} WHEN 422 THEN {_s(service.INPUT_GUIDANCE)} END AS guidance FROM h""",
    "q29_public_response": PLAN + f"SELECT qid, {GATE}, " + ", ".join(f"CASE WHEN qid % 2 = 1 THEN {c} END AS diag_{c}" for c in ("seed_count", "sibling_count", "result_count", "raw_candidate_count", "threshold_filtered_all")) + " FROM metrics",
    "q31_request_validation": f"""WITH p AS (SELECT conv_id, turn, conv_id + turn AS n,
        CASE WHEN (conv_id + turn) % 6 = 0 THEN '  ' WHEN (conv_id + turn) % 6 = 1 THEN repeat(text, 8) ELSE text END AS q FROM conversations)
      SELECT conv_id, turn, concat_ws(',', CASE WHEN length(coalesce(q, '')) > {service.QUESTION_CHARS} THEN 'question_length' END, CASE WHEN turn % 6 > {service.MAX_IMAGES} THEN 'images' END,
        CASE WHEN {_pick('n', '1039', '1110', None, '1109')} NOT IN {_in(STANDARD_IDS)} THEN 'standard_id' END, CASE WHEN {_pick('n', 'standard_body', 'nowhere', None)} NOT IN {_in(ZONES)} THEN 'zone' END,
        CASE WHEN n % 53 < 1 OR n % 53 > {service.MAX_TOP_K} THEN 'top_k' END, CASE WHEN n % 4 = 1 THEN 'request_id' END,
        CASE WHEN {STRIP.format("coalesce(q, '')")} = '' AND turn % 6 = 0 THEN 'question_or_image' END) AS errors FROM p""",
    "q32_image_validation": f"""WITH p AS (SELECT doc_id, {_pick('doc_id', *IMAGE_TYPES, 'image/bmp', 'text/plain')} AS mime,
        CASE doc_id % 5 WHEN 1 THEN to_base64(encode(text)) || chr(10) WHEN 2 THEN '' WHEN 3 THEN '*' || to_base64(encode(text)) ELSE to_base64(encode(text)) END AS data FROM documents)
      SELECT doc_id, concat_ws(',', CASE WHEN mime NOT IN {_in(IMAGE_TYPES)} THEN 'mime_type' END, CASE WHEN length(data) < 1 OR length(data) > {service.IMAGE_CHARS} THEN 'data_length' END,
        CASE WHEN NOT regexp_full_match(data, {_s(BASE64)}) THEN 'base64' END) AS errors, md5('data:' || mime || ';base64,' || data) AS url_md5 FROM p""",
    "q33_image_query": f"""WITH p AS (SELECT conv_id, turn, substr({STRIP.format("repeat(text, 30)")}, 1, {service.QUERY_CHARS}) AS sem, list_filter(list_transform(string_split(text, ' '), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS k FROM conversations)
      SELECT conv_id, turn, length(sem) AS n_semantic, md5(sem) AS semantic_md5, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS keyword_query, sem = '' OR len(k) = 0 AS invalid FROM p""",
    "q34_query_fallback": f"""WITH p AS (SELECT conv_id, turn, {STRIP.format('text')} AS q, {_pick('turn', '', None, '  ', 'semantic')} AS a, {_pick('conv_id', '', None, '  ', 'key words')} AS b FROM conversations),
      d AS (SELECT *, {STRIP.format("CASE WHEN length(a) > 0 THEN a ELSE q END")} AS dense_query FROM p),
      s AS (SELECT *, {STRIP.format("CASE WHEN length(b) > 0 THEN b ELSE dense_query END")} AS sparse_query FROM d)
      SELECT conv_id, turn, dense_query, sparse_query, dense_query = '' OR sparse_query = '' AS invalid FROM s""",
    "q35_rate_limit": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, event_id, i, [us] AS recent, true AS allowed FROM e WHERE i = 1
        UNION ALL
        SELECT user_id, event_id, i, CASE WHEN len(r) < {Q.RATE_LIMIT} THEN list_append(r, us) ELSE r END, len(r) < {Q.RATE_LIMIT}
        FROM (SELECT e.user_id, e.event_id, e.i, e.us, list_filter(f.recent, lambda t: e.us - t <= {Q.RATE_WINDOW}000000) AS r FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
      SELECT event_id, user_id, allowed FROM f""",
    "q36_idempotent_jobs": TRACE + "SELECT event_id, user_id AS request_id, outcome = 'created' AS created, sha256(user_id || '-' || no) AS job_id FROM steps WHERE op = 'create'",
    "q37_job_ttl_state": TRACE + "SELECT event_id, user_id AS request_id, op, outcome, no AS job_no FROM steps",
    "q38_chat_title": "WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS t FROM conversations) SELECT conv_id, turn, " + _title("t") + " AS title FROM p",
    "q39_history_cap": "WITH c AS (SELECT conv_id, max(turn) AS turns, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id), r AS (SELECT conv_id % 3 AS client, conv_id, t, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY turns * 1000 + conv_id % 1000 DESC, conv_id) AS pos FROM c) SELECT client, pos, conv_id, " + _title("t") + " AS title FROM r WHERE pos <= 30",
    "q40_lucene_escape": f"SELECT page_id, regexp_replace(url, '{SPECIAL}', '\\\\\\1', 'g') AS url, md5(regexp_replace(html, '{SPECIAL}', '\\\\\\1', 'g')) AS html_md5 FROM pages",
    "q41_standard_id": "WITH p AS (SELECT doc_id, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS digits FROM documents), f AS (SELECT doc_id, trim(CASE doc_id % " + str(len(Q.STANDARD_FORMS)) + " " + " ".join(_form(i, x) for i, x in enumerate(Q.STANDARD_FORMS)) + r" END) AS v FROM p), m AS (SELECT doc_id, v, nullif(regexp_extract(v, '(?i)^(?:K[\s-]*IFRS\s*)?(?:제\s*)?([0-9０-９]{4})(?:\s*호)?$', 1), '') AS standard_id FROM f) SELECT doc_id, standard_id, coalesce(v <> '' AND standard_id IS NULL, false) AS invalid FROM m",
    "q42_cjk_bigrams": f"""WITH p AS (SELECT doc_id, {WORDS.format(_pick('doc_id', *Q.PHRASES) + " || ' ' || coalesce(text, '')")} AS w FROM documents),
      t AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^\\p{{Hangul}}') AND length(x) > 2 THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END)) AS tokens FROM p)
      SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, '|')) AS tokens_md5 FROM t""",
    "q43_header_split": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN '10.0.' || user_id % 256 || '.1' WHEN event_id % 8 <> 0 THEN '127.0.0.1' ELSE 'unknown' END AS ip, 'http://a|http://' || event_type AS origins FROM events",
    "q44_strip_tag": "WITH" + CHUNKS + r" SELECT chunk_id, md5(regexp_replace(coalesce(contextualized_text, ''), '^\[[^\]\r\n]*\]\s*(?:\r?\n)?', '')) AS statement_md5 FROM chunks",
    "q45_answer_text": PLAN + f""", shown AS (SELECT c.qid, c.cite_no, '[' || c.evidence_id || '] ' || i.citation || chr(10) || regexp_replace(i.statement, '^\\[[^\\]\\r\\n]*\\]\\s*(?:\\r?\\n)?', '') AS line FROM cited c JOIN items i ON i.qid = c.qid AND i.evidence_id = c.evidence_id),
      lines AS (SELECT qid, string_agg(line, chr(10) ORDER BY cite_no) AS refs FROM shown GROUP BY qid)
      SELECT o.qid, CASE WHEN o.qid % 5 = 0 THEN {_s(service.UNRELIABLE_TEXT)} WHEN o.qid % 5 = 1 THEN {_s(service.ERROR_TEXT)}
        ELSE concat_ws(chr(10), '{service.ANSWER_HEAD}', o.conclusion, '', '{service.REASON_HEAD}', '1. ' || o.reasoning[1], '2. ' || o.reasoning[2], '', '{service.REFERENCE_HEAD}', coalesce(l.refs, '{service.NO_EVIDENCE_TEXT}')) END AS answer_text
      FROM output o LEFT JOIN lines l USING (qid)""",
    "q19_prompt_body": PLAN + f""", one AS (SELECT qid, string_agg('{{"evidence_id": ' || to_json(evidence_id) || ', "source_id": ' || to_json(source_id) || ', "citation": ' || to_json(citation) || ', "statement": ' || to_json(statement)
        || ', "pdf_page_start": ' || pdf_page_start || ', "pdf_page_end": ' || pdf_page_end || ', "candidate_source": ' || to_json(candidate_source) || '}}', ', ' ORDER BY evidence_no) AS list FROM items GROUP BY qid)
      SELECT qid, '{{"evidence": [' || list || ']' || CASE WHEN {STRIP.format("coalesce(question, '')")} <> '' THEN ', "question": ' || to_json({STRIP.format("question")}) ELSE '' END || '}}' AS body FROM one JOIN questions USING (qid)""",
    "q24_answer_end_to_end": PLAN + """, shown AS (SELECT c.qid, to_json(list({'evidence_id': i.evidence_id, 'citation': i.citation, 'statement': i.statement, 'pdf_page_start': i.pdf_page_start, 'pdf_page_end': i.pdf_page_end, 'candidate_source': i.candidate_source} ORDER BY c.cite_no))::VARCHAR AS evidence
        FROM cited c JOIN items i ON i.qid = c.qid AND i.evidence_id = c.evidence_id GROUP BY c.qid)
      SELECT o.qid, o.conclusion, array_to_string(o.reasoning, '|') AS reasoning, s.evidence, NULL::VARCHAR AS error FROM output o LEFT JOIN shown s USING (qid)""",
    "q46_request_json": f"""WITH p AS (SELECT conv_id, turn, text, (conv_id + turn) % 7 AS kind FROM conversations)
      SELECT conv_id, turn, CASE WHEN kind IN (0, 1, 4) THEN {STRIP.format('text')} WHEN kind IN (5, 6) THEN '' END AS question, CASE WHEN kind = 5 THEN 1 WHEN kind NOT IN (2, 3) THEN 0 END::BIGINT AS n_images,
        CASE kind WHEN 0 THEN 5 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 99 ELSE 10 END::BIGINT AS top_k, CASE WHEN kind NOT IN (2, 3) THEN false END AS debug,
        concat_ws(',', CASE WHEN kind IN (2, 3) THEN 'json' WHEN kind = 1 THEN 'unknown_key' WHEN kind = 5 THEN 'unknown_image_key' WHEN kind = 6 THEN 'type' END, CASE WHEN kind IN (0, 1, 4) AND length(text) > {service.QUESTION_CHARS} THEN 'question_length' END,
          CASE WHEN kind = 4 THEN 'standard_id,top_k' END, CASE WHEN kind = 6 OR kind IN (0, 1, 4) AND {STRIP.format('text')} = '' THEN 'question_or_image' END) AS errors FROM p""",
    "q47_response_json": PLAN + f""", g AS (SELECT qid, seed_count, result_count, {GATE}, CASE WHEN threshold_filtered_all THEN {_s(service.FILTERED_REASONING)} ELSE {_s(service.EMPTY_REASONING)} END AS why FROM metrics),
      f AS (SELECT c.qid, i.citation, i.evidence_id FROM cited c JOIN items i ON i.qid = c.qid AND i.evidence_id = c.evidence_id QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY c.cite_no) = 1)
      SELECT g.qid, 'status,reason,conclusion,reasoning,evidence' || CASE WHEN g.qid % 2 = 1 THEN ',diagnostics' ELSE '' END AS keys, g.status, g.reason, coalesce(g.conclusion, o.conclusion) AS conclusion,
        CASE WHEN g.result_count > 0 THEN o.reasoning[1] ELSE g.why END AS first_step, f.citation AS first_citation, f.evidence_id AS first_evidence,
        CASE WHEN g.qid % 2 = 1 THEN g.seed_count END AS seed_count, CASE WHEN g.qid % 2 = 1 THEN q.want_standard END AS standard_id, CASE WHEN g.qid % 2 = 1 THEN g.reason END AS diagnostic_reason
      FROM g JOIN questions q USING (qid) LEFT JOIN output o USING (qid) LEFT JOIN f USING (qid)""",
    "q48_score_event": PLAN + f""", chosen AS (SELECT qid, to_json(list(chunk_id ORDER BY pos))::VARCHAR AS ids FROM fused_pos WHERE pos <= {H.seed_top_k} GROUP BY qid)
      SELECT q.qid, 'event,question_hash,filters,thresholds,dense,sparse,selected_chunk_ids' AS keys, sha256(q.question) AS question_hash, q.want_standard AS standard_id, q.want_zone AS zone,
        {H.dense_min_score}::DOUBLE AS dense_floor, {H.sparse_min_score}::DOUBLE AS sparse_floor, d.chunk_id AS best_dense, d.score >= {H.dense_min_score} AS best_dense_passed, s.chunk_id AS best_sparse, coalesce(c.ids, '[]') AS selected
      FROM questions q LEFT JOIN dense_f d ON d.qid = q.qid AND d.rank = 1 LEFT JOIN sparse_f s ON s.qid = q.qid AND s.rank = 1 LEFT JOIN chosen c ON c.qid = q.qid""",
    "q49_hit_payload": PLAN + """SELECT qid, chunk_id, rank, standard_id, zone, 'paragraph' AS chunk_type, md5(text) AS text_md5, md5(contextualized_text) AS contextualized_text_md5, citation_label, pdf_page_start, pdf_page_end, 3 AS search_priority
      FROM dense_f JOIN chunks USING (chunk_id)""",
    "q50_job_quota": f"""WITH RECURSIVE e AS (SELECT user_id % {Q.CLIENTS} AS client, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 3 <> 0 THEN user_id || '-' || event_type END AS request,
        row_number() OVER (PARTITION BY user_id % {Q.CLIENTS} ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT client, event_id, i, 'created' AS outcome, [us] AS recent, CASE WHEN request IS NULL THEN [] ELSE [{{'r': request, 'at': us}}] END AS live FROM e WHERE i = 1
        UNION ALL
        SELECT client, event_id, i, CASE WHEN old THEN 'existing' WHEN len(now) < {3 * Q.RATE_LIMIT} THEN 'created' ELSE 'refused' END,
          CASE WHEN NOT old AND len(now) < {3 * Q.RATE_LIMIT} THEN list_append(now, us) ELSE now END,
          CASE WHEN NOT old AND len(now) < {3 * Q.RATE_LIMIT} AND request IS NOT NULL THEN list_append(held, {{'r': request, 'at': us}}) ELSE held END
        FROM (SELECT *, coalesce(len(list_filter(held, lambda x: x.r = request)) > 0, false) AS old FROM (
          SELECT e.client, e.event_id, e.i, e.us, e.request, list_filter(f.recent, lambda t: e.us - t <= {Q.RATE_WINDOW}000000) AS now, list_filter(f.live, lambda x: e.us - x.at <= {Q.JOB_TTL}000000) AS held
          FROM f JOIN e ON e.client = f.client AND e.i = f.i + 1)))
      SELECT event_id, client, outcome FROM f""",
    "q51_stored_history": f"""WITH c AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, unnest(CASE conv_id % 4 WHEN 2 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS pos, t FROM c)
      SELECT conv_id, pos, 'c' || conv_id AS id, {_title("t")} AS title, 2 AS n_messages FROM p""",
}
