"""Engine settings with their defaults and the ranges they must lie in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # fixed default values
    chunk_size: int = 2000
    # False and 20 drop text before the first heading of a level, and short sections.
    keep_preamble: bool = True
    min_section: int = 0
    content_preview_chars: int = 200
    # Caps a caller may set; none by default.
    search_limit_max: int | None = None
    max_query_chars: int | None = None
    log_top: int | None = None
    rrf_k: int = 60
    rerank_enabled: bool = False
    rerank_pool: int = 20
    collapse_by_doc: bool = False
    mmr_lambda: float = 1.0
    title_weight: float = 10.0
    content_weight: float = 1.0
    embed_dim: int = 384
    embed_batch_size: int = 50
    max_doc_bytes: int = 50 * 1024 * 1024
    writable: bool = False
    access_log: bool = True
    # Spark-side settings
    # Of a new store; an existing one knows its own number.
    store_buckets: int | None = None
    small_rows: int = 200_000
    small_bytes: int = 8 * 1024 * 1024

    def __post_init__(self) -> None:
        rules = (
            ("chunk_size", self.chunk_size >= 500, ">= 500"),
            ("min_section", self.min_section >= 0, ">= 0"),
            ("content_preview_chars", self.content_preview_chars >= 50, ">= 50"),
            ("search_limit_max", self.search_limit_max is None or self.search_limit_max >= 1, ">= 1"),
            ("embed_batch_size", self.embed_batch_size >= 1, ">= 1"),
            ("mmr_lambda", 0.0 <= self.mmr_lambda <= 1.0, "within [0, 1]"),
            ("rerank_pool", self.rerank_pool >= 1, ">= 1"),
            ("rrf_k", self.rrf_k >= 1, ">= 1"),
            ("store_buckets", self.store_buckets is None or self.store_buckets >= 1, ">= 1"),
        )
        for name, ok, rule in rules:
            if not ok:
                raise ValueError(f"{name} must be {rule}, got {getattr(self, name)!r}")

    def clamp_limit(self, limit: int) -> int:
        return max(1, limit if self.search_limit_max is None else min(self.search_limit_max, limit))

    def candidate_limit(self, limit: int, rerank: bool) -> int:
        """How many hits to retrieve so that the later steps have headroom."""
        wanted = max(limit, self.rerank_pool) if rerank else limit
        if self.collapse_by_doc or 0.0 < self.mmr_lambda < 1.0:
            wanted = max(wanted, limit * 5)
        return wanted if self.search_limit_max is None else max(1, min(max(self.search_limit_max, self.rerank_pool), wanted))
