"""Settings whose defaults are part of the engine's semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # The documented defaults.
    chunk_size: int = 5000
    overlap: int = 200
    max_depth: int = 3
    max_concurrent: int = 10
    num_results: int = 5
    semantic_threshold: float = 0.5
    rerank_threshold: float = 0.3
    use_contextual_embeddings: bool = False
    use_hybrid_search: bool = False
    use_reranking: bool = False
    use_agentic_rag: bool = False
    use_result_diversification: bool = True
    mmr_lambda: float = 0.7
    max_results_per_content_type: int = 3
    embedding_max_chars: int = 32_000
    rrf_k: int = 60
    code_min_length: int = 50
    disable_thinking: bool = False
    # Not part of the results: model batches and where models are.
    embedding_batch: int = 100
    summary_batch: int = 10
    contextual_batch: int = 20
    reranker_paths: tuple[str, ...] = ()  # tried in this order: a local file, a URL, a default name


@dataclass(frozen=True)
class SearchRequest:
    query: str
    source: str | None = None
    num_results: int = 5
    semantic_threshold: float = 0.5
    search_type: str = "semantic"  # semantic, hybrid or code

    def __post_init__(self):
        if not 1 <= len(self.query) <= 1000:
            raise ValueError("query must have 1 to 1000 characters")
        if not 1 <= self.num_results <= 20:
            raise ValueError("num_results must be between 1 and 20")
        if not 0 <= self.semantic_threshold <= 1:
            raise ValueError("semantic_threshold must be between 0 and 1")
        if self.search_type not in ("semantic", "hybrid", "code"):
            raise ValueError("search_type must be semantic, hybrid or code")


@dataclass(frozen=True)
class CrawlRequest:
    url: str
    max_depth: int = 3
    max_concurrent: int = 10
    chunk_size: int = 5000
    overlap: int = 200

    def __post_init__(self):
        for name, value, lo, hi in (("max_depth", self.max_depth, 1, 10), ("max_concurrent", self.max_concurrent, 1, 50), ("chunk_size", self.chunk_size, 100, 10_000), ("overlap", self.overlap, 0, 1000)):
            if not lo <= value <= hi:
                raise ValueError(f"{name} must be between {lo} and {hi}")
        if self.overlap >= self.chunk_size:
            raise ValueError("overlap must be less than chunk_size")
