"""Documents of the service contract: requests read from JSON text, responses and log events written as it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators import channels, service
from quillstream.operators.evidence import METADATA
from quillstream.schemas import PAYLOAD, REQUEST

DEFAULT_TOP_K, DEFAULT_NAME = 10, "image"
#: Counts of a retrieval that a caller may see.
COUNTS = ("seed_count", "sibling_count", "result_count", "raw_candidate_count", "threshold_filtered_all")


def _unknown(text: Column, known: list[str]) -> Column:
    return F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, known)))) > 0


def read_requests(df: DataFrame, col: str = "body") -> DataFrame:
    """The columns of ``df`` without ``col``, the fields of the request with their defaults, and ``errors``.

    Keys beyond the schema's, of a request or of an image, are an error; so is text that is no JSON object (all
    fields are null then) and a value of another type.  Null text is an error like any text that is no object.
    """
    text = F.col(col)
    keys, loose = [f.name for f in REQUEST.fields], T.StructType([T.StructField(f.name, T.StringType()) for f in REQUEST.fields])
    image = REQUEST["images"].dataType.elementType
    rows = df.withColumn("r", F.from_json(text, REQUEST)).withColumn("raw", F.from_json(text, loose))
    is_object = F.json_object_keys(text).isNotNull()
    images = F.from_json(F.col("raw.images"), T.ArrayType(T.StringType()))
    # a scalar that was given and can't be read has another type
    scalars = [f.name for f in REQUEST.fields if f.name != "images"]
    rows = rows.withColumn("r", F.col("r").withField("top_k", F.coalesce("r.top_k", F.col("raw.top_k").try_cast("int"))).withField("debug", F.coalesce("r.debug", F.col("raw.debug").try_cast("boolean"))))
    wrong = F.array_compact(F.array(*[F.when(F.col(f"raw.{n}").isNotNull() & F.col(f"r.{n}").isNull(), F.lit("type")) for n in scalars], F.when(F.col("raw.images").isNotNull() & images.isNull(), F.lit("type"))))
    own = F.array_compact(F.array(
        F.when(_unknown(text, keys), F.lit("unknown_key")),
        F.when(F.exists(images, lambda x: F.coalesce(_unknown(x, [f.name for f in image.fields]), F.lit(True))), F.lit("unknown_image_key")),
    ))
    attached = F.coalesce(F.transform("r.images", lambda x: F.struct(F.coalesce(x["name"], F.lit(DEFAULT_NAME)).alias("name"), x["mime_type"].alias("mime_type"), x["data"].alias("data"))), F.array().cast(REQUEST["images"].dataType))
    fields = {
        "question": service.strip(F.coalesce("r.question", F.lit(""))), "images": attached, "standard_id": F.col("r.standard_id"), "zone": F.col("r.zone"),
        "top_k": F.coalesce("r.top_k", F.lit(DEFAULT_TOP_K)), "debug": F.coalesce("r.debug", F.lit(False)), "request_id": F.col("r.request_id"),
    }
    rules = service.request_errors(F.col("r.question"), F.size(attached), F.col("r.standard_id"), F.col("r.zone"), F.coalesce("r.top_k", F.lit(DEFAULT_TOP_K)), F.col("r.request_id"))
    of_images = F.flatten(F.transform(attached, lambda x: service.image_errors(x["mime_type"], x["data"], x["name"])))
    errors = F.when(~is_object, F.array(F.lit("json"))).otherwise(F.array_distinct(F.concat(own, F.array_distinct(wrong), rules, of_images)))
    kept = [c for c in df.columns if c != col]
    return rows.select(*kept, *[F.when(is_object, c).alias(n) for n, c in fields.items()], errors.alias("errors"))


def evidence_item(columns: list[str]) -> list[str]:
    """The fields of a public evidence item that ``columns`` has."""
    return [c for c in ("evidence_id", "citation", "statement", "source_id", *METADATA) if c in columns]


def public_response(answers: DataFrame, metrics: DataFrame, questions: DataFrame, debug: Column) -> DataFrame:
    """(qid, body): the response as JSON without nulls.

    ``answers`` has (qid, conclusion, reasoning, evidence) of the questions with results; the others get the fixed
    texts.  Where ``debug`` (over columns of ``questions``) holds, the diagnostics are there.
    """
    gate = service.gate(F.col("result_count"), F.col("threshold_filtered_all"))
    filters = F.struct(F.col("want_standard").alias("standard_id"), F.col("want_zone").alias("zone"))
    rows = questions.select("qid", filters.alias("filters"), debug.alias("debug")).join(metrics, "qid").join(answers.select("qid", "conclusion", "reasoning", "evidence"), "qid", "left")
    empty = F.array().cast(answers.schema["evidence"].dataType)
    diagnostics = F.struct(F.struct("filters", *COUNTS).alias("retrieval"), gate["status"].alias("status"), gate["reason"].alias("reason"))
    body = F.struct(
        gate["status"].alias("status"), gate["reason"].alias("reason"), F.coalesce(gate["conclusion"], F.col("conclusion")).alias("conclusion"),
        F.coalesce(F.when(gate["reasoning"].isNotNull(), F.array(gate["reasoning"])), F.col("reasoning")).alias("reasoning"),
        F.coalesce("evidence", empty).alias("evidence"), F.when(F.col("debug"), diagnostics).alias("diagnostics"),
    )
    return rows.select("qid", F.to_json(body).alias("body"))


def score_events(questions: DataFrame, dense: DataFrame, sparse: DataFrame, selected: DataFrame, floors: tuple[float | None, float | None], include_question: bool = False) -> DataFrame:
    """(qid, event): one JSON document a question about the scores of its hits.

    ``dense`` and ``sparse`` have (qid, chunk_id, rank, score), ``selected`` (qid, chunk_id, pos); the text of the
    question is there only if asked for.  A channel without hits is an empty list.
    """

    def listed(hits: DataFrame, floor: float | None, name: str) -> DataFrame:
        one = F.struct("rank", F.struct("chunk_id", "rank", "score", channels.passes(F.col("score"), floor).alias("passed")).alias("hit"))
        return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["hit"]).alias(name))

    none = "array<struct<chunk_id: string, rank: bigint, score: double, passed: boolean>>"
    chosen = selected.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    rows = questions.select("qid", "question", "want_standard", "want_zone")
    for part in (listed(dense, floors[0], "dense"), listed(sparse, floors[1], "sparse"), chosen):
        rows = rows.join(part, "qid", "left")
    event = F.struct(
        F.lit("retrieval_scores").alias("event"), F.sha2(F.encode("question", "UTF-8"), 256).alias("question_hash"),
        F.struct(F.col("want_standard").alias("standard_id"), F.col("want_zone").alias("zone")).alias("filters"),
        F.struct(F.lit(floors[0]).alias("dense"), F.lit(floors[1]).alias("sparse")).alias("thresholds"),
        F.coalesce("dense", F.array().cast(none)).alias("dense"), F.coalesce("sparse", F.array().cast(none)).alias("sparse"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("selected_chunk_ids"), *([F.col("question")] if include_question else []),
    )
    return rows.select("qid", F.to_json(event, {"ignoreNullFields": "false"}).alias("event"))


def with_payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of a chunk that travel with them."""
    return hits.join(chunks.select("chunk_id", *PAYLOAD), "chunk_id")


def stored_history(df: DataFrame, col: str = "value", most: int = 30) -> DataFrame:
    """The chats of a client's stored JSON list: entries that aren't objects with an id, a title and a list of messages
    are left out, the rest are the ``most`` first; text that is no list gives none."""
    raw = F.from_json(F.col(col), T.ArrayType(T.StringType()))
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("messages", T.ArrayType(T.StringType()))])
    ok = lambda x: x["id"].isNotNull() & x["title"].isNotNull() & x["messages"].isNotNull()
    chats = F.filter(F.transform(raw, lambda x: F.from_json(x, kind)), lambda x: F.coalesce(ok(x), F.lit(False)))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(F.slice(chats, 1, most)).alias("pos", "chat")).select(*rest, "pos", "chat.id", "chat.title", F.size("chat.messages").alias("n_messages"))
