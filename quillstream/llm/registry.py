"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import line_dedup, topk_search
from quillstream.llm.bpe import op6_bpe
from quillstream.llm.common import load
from quillstream.llm.jaccard_join import op1_jaccard_join
from quillstream.llm.langid import op8_language_id
from quillstream.llm.line_dedup import op4_line_dedup
from quillstream.llm.mixing import op2_mixing
from quillstream.llm.secret_scan import op5_secret_scan
from quillstream.llm.topk_search import op10_topk_search
from quillstream.llm.toxicity import op9_toxicity
from quillstream.llm.warc import op7_warc
from quillstream.llm.winnow import op3_fingerprints


def _bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return op6_bpe(load(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": lambda s, d: op1_jaccard_join(load(s, d, "documents")),
        "op2_mixing": lambda s, d: op2_mixing(load(s, d, "documents")),
        "op3_fingerprints": lambda s, d: op3_fingerprints(load(s, d, "documents")),
        "op4_line_dedup": lambda s, d: op4_line_dedup(load(s, d, "documents")),
        "op5_secret_scan": lambda s, d: op5_secret_scan(load(s, d, "documents")),
        "op6_bpe": _bpe,
        "op7_warc": lambda s, d: op7_warc(load(s, d, "pages")),
        "op8_language_id": lambda s, d: op8_language_id(load(s, d, "documents")),
        "op9_toxicity": lambda s, d: op9_toxicity(load(s, d, "documents"), load(s, d, "labels")),
        "op10_topk_search": lambda s, d: op10_topk_search(load(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE, "op10_topk_search": topk_search.ORACLE}
