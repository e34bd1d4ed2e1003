"""Evidence: a numbered catalog under a character budget, the model's body, and the answer joined back to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.config import AnswerConfig
from quillstream.functions.text import citation, markers, or_else, strip
from quillstream.schemas import MODEL_PAYLOAD

#: Metadata copied into an evidence item where it isn't null.
METADATA = ("pdf_page_start", "pdf_page_end", "graph_path", "graph_hop", "candidate_source")


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def candidates(results: DataFrame, config: AnswerConfig) -> DataFrame:
    """The first ``max_candidates`` rows (qid, pos, …) with source_id, body, citation, and an error where ids are blank or repeat."""
    cut = results.filter(F.col("pos") <= config.max_candidates)
    source = strip(F.coalesce(or_else(F.col("chunk_id"), _col(cut, "node_id")), F.lit("")))
    body = strip(F.coalesce(or_else(_col(cut, "contextualized_text"), _col(cut, "text")), F.lit("")))
    cite = citation(_col(cut, "citation_label"), _col(cut, "citation"), _col(cut, "standard_id"), _col(cut, "paragraph_id"), source)
    rows = cut.select("qid", "pos", source.alias("source_id"), body.alias("body"), cite.alias("citation"), *[c for c in METADATA if c in cut.columns])
    nth = F.row_number().over(Window.partitionBy("qid", "source_id").orderBy("pos"))
    error = F.when(F.length("source_id") == 0, "empty id").when(nth > 1, "duplicate id")
    return rows.withColumn("error", error)


def catalog(rows: DataFrame, config: AnswerConfig) -> DataFrame:
    """(qid, evidence_no, evidence_id, source_id, citation, statement, metadata…) of candidate rows.

    A row takes min(its length, the cap per row, what the rows before it left of the budget): with a the capped
    length and S the sum of a before the row this is max(0, min(a, budget - S)), one running sum per question.
    """
    a = F.least(F.length("body"), F.lit(config.max_candidate_chars)).cast("long")
    before = F.coalesce(F.sum(a).over(Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(a, F.lit(config.max_context_chars) - before)).cast("int")
    kept = rows.withColumn("take", take).filter("take > 0")
    no = F.row_number().over(Window.partitionBy("qid").orderBy("pos")).cast("long")
    extra = [c for c in METADATA if c in rows.columns]
    return kept.select("qid", no.alias("evidence_no"), "source_id", "citation", F.substring(F.col("body"), F.lit(1), F.col("take")).alias("statement"), *extra).withColumn(
        "evidence_id", F.concat(F.lit("E"), F.col("evidence_no").cast("string"))
    )


def offered(items: DataFrame) -> DataFrame:
    """(qid, evidence): the catalog as one ordered array of structs per question (bounded by the candidate cap)."""
    extra = [c for c in METADATA if c in items.columns]
    one = F.struct("evidence_no", F.struct("evidence_id", "source_id", "citation", "statement", *extra).alias("item"))
    return items.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["item"]).alias("evidence"))


def json_string(c: Column) -> Column:
    """A string as JSON text; null stays null."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _member(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), text)


def prompt_body(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, body): JSON text with blanks after separators, of the evidence, then of the question unless it is empty.

    Fields of an item that are null are left out.  Control characters that JSON has no letter for are written with
    upper-case digits.
    """
    q = questions.select("qid", strip(F.coalesce("question", F.lit(""))).alias("question"))
    rows = offered(items).join(q, "qid")
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def text(x: Column, name: str) -> Column:
        kind = kinds[name]
        return json_string(x[name]) if kind == "string" else F.to_json(x[name]) if kind.startswith(("array", "struct", "map")) else x[name].cast("string")

    names = ["evidence_id", "source_id", "citation", "statement", *[c for c in METADATA if c in items.columns]]
    item = lambda x: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[_member(n, text(x, n)) for n in names])), ", "), F.lit("}"))
    evidence = _member("evidence", F.concat(F.lit("["), F.array_join(F.transform("evidence", item), ", "), F.lit("]")))
    question = F.when(F.length("question") > 0, _member("question", json_string(F.col("question"))))
    return rows.select("qid", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(evidence, question)), ", "), F.lit("}")).alias("body"))


def parse_payload(answers: DataFrame, col: str = "model_output") -> DataFrame:
    """(qid, conclusion, reasoning, declared, error) of model output as JSON text."""
    p = F.from_json(F.col(col), MODEL_PAYLOAD)
    conclusion = strip(F.coalesce(p["conclusion"], F.lit("")))
    clean = lambda a: F.coalesce(F.transform(a, lambda x: strip(F.coalesce(x, F.lit("None")))), F.array().cast("array<string>"))
    error = (
        F.when(F.length(strip(F.coalesce(F.col(col), F.lit("")))) == 0, "empty output")
        .when(~F.col(col).rlike(r"^\s*\{"), "not an object")
        .when(F.json_object_keys(col).isNull(), "malformed")
        .when(F.length(conclusion) == 0, "empty conclusion")
    )
    return answers.select("qid", conclusion.alias("conclusion"), F.filter(clean(p["reasoning"]), lambda x: F.length(x) > 0).alias("reasoning"), clean(p["evidence"]).alias("declared"), error.alias("error"))


def cited_ids(parsed: DataFrame) -> DataFrame:
    """(qid, at from 0, evidence_id): declared ids, then markers of the conclusion and of each step; the first of repeats."""
    texts = F.concat(F.array("conclusion"), F.col("reasoning"))
    ids = F.array_distinct(F.concat("declared", F.flatten(F.transform(texts, markers))))
    return parsed.filter("error is null").select("qid", F.posexplode(ids).alias("at", "evidence_id"))


def cited_evidence(cited: DataFrame, items: DataFrame) -> DataFrame:
    """Cited ids that the catalog has, in citation order, with what the catalog says; unknown ids vanish."""
    keep = ["citation", "statement", *[c for c in ("pdf_page_start", "pdf_page_end", "candidate_source") if c in items.columns]]
    return cited.join(items.select("qid", "evidence_id", *keep), ["qid", "evidence_id"]).select("qid", "at", "evidence_id", *keep)


Model = Callable[[DataFrame], DataFrame]


def stub_model(items: DataFrame) -> DataFrame:
    """A deterministic stand-in for a language model: (qid, model_output) that cites the first, an unknown and the last item."""
    n = items.groupBy("qid").agg(F.max("evidence_no").alias("n"), F.min_by("citation", "evidence_no").alias("c"))
    last = F.concat(F.lit("E"), F.col("n").cast("string"))
    payload = F.struct(
        F.concat(F.lit(" "), F.col("c"), F.lit(" [E1] ")).alias("conclusion"),
        F.array(F.concat(F.lit("step ["), last, F.lit("]")), F.lit("  "), F.lit(" done ")).alias("reasoning"),
        F.array(F.lit("E9999"), last, F.lit(" E1 ")).alias("evidence"),
    )
    return n.select("qid", F.to_json(payload).alias("model_output"))


def answer(items: DataFrame, model: Model = stub_model) -> DataFrame:
    """(qid, conclusion, reasoning, evidence, error): the model's output assembled with the catalog."""
    parsed = parse_payload(model(items))
    hit = cited_evidence(cited_ids(parsed), items)
    extra = [c for c in hit.columns if c not in ("qid", "at")]
    lists = hit.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*extra).alias("item")))), lambda x: x["item"]).alias("evidence"))
    return parsed.join(lists, "qid", "left").select("qid", "conclusion", "reasoning", "evidence", "error")
