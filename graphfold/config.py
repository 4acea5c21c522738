"""Settings that affect results or load."""

from __future__ import annotations

from dataclasses import dataclass, fields

from graphfold.errors import Invalid

#: Setting, default, least and largest value.
LIMITS = {
    "dim": (2000, 1, None),
    "retrieval_top_k": (8, 1, 100),
    "expand_hops": (1, 0, 5),
    "context_token_budget": (4000, 100, None),
    "global_map_top_k": (6, 1, 50),
    "local_entity_top_k": (5, 1, 50),
    "chunk_size": (1200, 100, 16000),
    "chunk_overlap": (200, 0, 4000),
    "extraction_concurrency": (4, 1, None),
    "global_map_concurrency": (4, 1, None),
    "community_min_size": (3, 2, None),
    "embedding_batch_size": (64, 1, 2000),
    "max_retries": (2, 0, 8),
}


@dataclass(frozen=True)
class EngineConfig:
    dim: int = 2000
    retrieval_top_k: int = 8
    expand_hops: int = 1
    context_token_budget: int = 4000
    global_map_top_k: int = 6
    local_entity_top_k: int = 5
    auto_entity_score_threshold: float = 0.55
    chunk_size: int = 1200
    chunk_overlap: int = 200
    extraction_concurrency: int = 4
    global_map_concurrency: int = 4
    community_min_size: int = 3
    embedding_batch_size: int = 64
    max_retries: int = 2
    retry_base: float = 0.25
    retry_cap: float = 2.0

    def __post_init__(self):
        for f in fields(self):
            _, least, most = LIMITS.get(f.name, (None, None, None))
            value = getattr(self, f.name)
            if least is not None and value < least or most is not None and value > most:
                raise Invalid(f"{f.name} is {value}; it must lie in {least}..{'' if most is None else most}")
