"""Settings with the fixed default values of the engine's semantics."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    target_chars: int = 1100
    overlap_chars: int = 180
    min_chars: int = 240


@dataclass(frozen=True)
class SearchConfig:
    k1: float = 1.4
    b: float = 0.75
    top_k: int = 12
    pulled: int = 36
    per_doc: int = 2
    min_score: float = 0.08
    keyword_depth: int = 50
    compare: int = 10
    rerank_candidates: int = 12
    rerank_keep: int = 8
    shown: int = 8
    min_confidence: float = 0.28


@dataclass(frozen=True)
class AnnConfig:
    threshold: int = 20_000
    m: int = 12
    ef_construction: int = 100
    ef_search: int = 64
    seed: int = 7


@dataclass(frozen=True)
class WorkspaceConfig:
    max_docs: int = 5
    chat_top_k: int = 5
    history_turns: int = 4
    min_mentions: int = 1
    max_chunks_per_doc: int = 500
    entity_chunks_per_doc: int = 100
    max_entities: int = 40


@dataclass(frozen=True)
class Config:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    ann: AnnConfig = field(default_factory=AnnConfig)
    workspace: WorkspaceConfig = field(default_factory=WorkspaceConfig)
    passages: int = 4
    hash_dims: int = 512
