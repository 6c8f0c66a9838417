"""Settings of the engine, with their defaults; environment variables QUERN_<NAME> override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Config:
    keyword_top_k: int = 30
    vector_top_k: int = 30
    merged_limit: int = 50
    rerank_top_k: int = 20
    max_tokens: int = 4000
    max_chunks: int = 8
    chunk_size: int = 600
    chunk_overlap: int = 100
    chunker: str = "auto"
    adaptive_chunking: bool = True
    weight_vector: float = 0.55
    weight_keyword: float = 0.45
    expansion: bool = False
    neighbour_window: int = 1
    compression: bool = True
    strategy: str = "auto"
    retry_floor: float = 0.3
    deep_min: int = 2
    deep_max: int = 4
    deep_per_query: int = 12
    mmr_lambda: float = 0.7
    hybrid: bool = True

    def __post_init__(self):
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap from 0 to below chunk_size")


def load_config(env: dict[str, str] | None = None) -> Config:
    """A Config from the environment; values that don't parse keep their defaults."""
    env = os.environ if env is None else env
    out = {}
    for f in fields(Config):
        raw = env.get(f"QUERN_{f.name.upper()}", "").strip()
        if not raw:
            continue
        kind = type(f.default)
        try:
            out[f.name] = raw.lower() in _TRUE if kind is bool else kind(raw)
        except ValueError:
            continue
    return Config(**out)
