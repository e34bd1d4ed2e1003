"""Validated settings; values are passed into plans as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import Any


def _positive(owner: Any, *names: str) -> None:
    for name in names:
        if getattr(owner, name) <= 0:
            raise ValueError(f"{name} must be greater than zero")


def _from_mapping(cls, values: dict[str, Any]):
    """Known keys with their declared types; unknown keys are ignored, missing ones keep defaults."""
    out = {}
    for f in fields(cls):
        if f.name in values:
            v = values[f.name]
            out[f.name] = None if v is None else (float(v) if "float" in str(f.type) else int(v))
    return cls(**out)


@dataclass(frozen=True)
class HybridConfig:
    """Two-channel search: candidates per channel, fusion constants, score floors."""

    dense_top_k: int = 50
    sparse_top_k: int = 50
    seed_top_k: int = 6
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    embedding_dimensions: int = 3072
    dense_min_score: float | None = None
    sparse_min_score: float | None = None

    def __post_init__(self) -> None:
        _positive(self, "dense_top_k", "sparse_top_k", "seed_top_k", "rrf_k", "embedding_dimensions")
        if self.dense_weight < 0 or self.sparse_weight < 0 or self.dense_weight + self.sparse_weight == 0:
            raise ValueError("weights must be nonnegative and not both zero")
        for t in (self.dense_min_score, self.sparse_min_score):
            if t is not None and not math.isfinite(t):
                raise ValueError("score floors must be finite")

    @classmethod
    def load(cls, data: dict[str, Any]) -> HybridConfig:
        """From a document with a ``hybrid`` section, or with the keys at its root."""
        return _from_mapping(cls, data.get("hybrid", data) or {})


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 6
    max_siblings: int = 8

    def __post_init__(self) -> None:
        _positive(self, "top_k")
        if self.max_siblings < 0:
            raise ValueError("max_siblings must not be negative")

    @classmethod
    def load(cls, data: dict[str, Any]) -> RetrievalConfig:
        return _from_mapping(cls, data.get("retrieval") or {})


@dataclass(frozen=True)
class AnswerConfig:
    max_candidates: int = 20
    max_candidate_chars: int = 1800
    max_context_chars: int = 14000
    max_question_chars: int = 12000
    max_output_tokens: int = 8000

    def __post_init__(self) -> None:
        _positive(self, *(f.name for f in fields(self)))

    @classmethod
    def load(cls, data: dict[str, Any]) -> AnswerConfig:
        """From a document with an ``answer`` section."""
        return _from_mapping(cls, data.get("answer") or {})


# The settings that a deployment ships with.
SHIPPED_HYBRID = HybridConfig(seed_top_k=10, dense_min_score=0.60, sparse_min_score=30.0)
SHIPPED_RETRIEVAL = RetrievalConfig(top_k=10)
SHIPPED_ANSWER = AnswerConfig(max_context_chars=50000)


def missing_settings(names: list[str], values: dict[str, str]) -> list[str]:
    """Required names without a value that has text."""
    return [n for n in names if not (values.get(n) or "").strip()]


def read_yaml(path: str) -> dict[str, Any]:
    """A settings document; PyYAML is optional."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs PyYAML; pass a mapping to load() instead") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
