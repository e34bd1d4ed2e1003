"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed enums of the request contract.
STANDARD_IDS = ("1032", "1039", "1107", "1109")
ZONES = (
    "standard_body", "appendix_definitions", "application_guidance", "application_examples", "implementation_guidance",
    "basis_for_conclusions", "dissenting_opinion", "front_matter", "committee_resolution", "amendment_history", "ifrs_comparison",
)
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")

#: Columns of a chunk that travel with a search hit.
PAYLOAD = ("standard_id", "zone", "chunk_type", "text", "contextualized_text", "citation_label", "pdf_page_start", "pdf_page_end", "search_priority")

MODEL_PAYLOAD = T.StructType([
    T.StructField("conclusion", T.StringType()), T.StructField("reasoning", T.ArrayType(T.StringType())), T.StructField("evidence", T.ArrayType(T.StringType())),
])

REQUEST = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("data", T.StringType())]))),
    T.StructField("standard_id", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("top_k", T.IntegerType()),
    T.StructField("debug", T.BooleanType()), T.StructField("request_id", T.StringType()),
])
