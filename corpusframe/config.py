"""Tunable values, passed to operators instead of being read from a settings table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Upload gates.
    max_files: int = 5
    max_file_bytes: int = 5 * 1024 * 1024
    allowed_types: tuple[str, ...] = (
        "application/pdf",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/msword",
        "text/plain",
        "text/markdown",
    )

    # Chunking and summaries.
    chunk_size: int = 1000
    chunk_overlap: int = 200
    summary_window: int = 12000
    summary_parts: int = 6
    profile_characters: int = 2000

    # Retrieval.
    top_k: int = 5
    rrf_k: int = 60
    max_distance: float | None = None
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    max_documents: int = 3
    max_sections: int = 4
    candidates_per_document: int = 8

    # Coverage.
    coverage_documents: int = 8
    chunks_per_document: int = 2
    excerpt_characters: int = 420
    require_keyword_match: bool = True

    # Evidence and context.
    min_overlap: float = 0.2
    skip_model_above: float = 0.75
    max_topic_distance: float = 1.05
    context_tokens: int = 8192
    context_reserve_tokens: int = 1200
    characters_per_token: float = 3.5

    # Conversations and history.
    history_turns: int = 4
    carry_over_chunks: int = 3
    reuse_lookback: int = 20
    retain_runs: int = 500
    catalogue_limit: int = 50
    catalogue_summary_characters: int = 140

    # Answer reuse.
    cache_ttl_seconds: int = 86400
    web_cache_ttl_seconds: int = 3600
    similarity_threshold: float = 0.95
    cache_candidates: int = 500

    # Size bounds for what may travel to every task (see operators/keyword.py, vector.py).
    resident_terms: int = 200_000
    hot_rows: int = 1_000_000
    resident_hits: int = 500_000
    resident_questions: int = 8192
    resident_values: int = 4_000_000
    block_questions: int = 8192
    block_vectors: int = 50_000
    block_values: int = 8_000_000

    # Vector lists (operators/lists.py): their number, and the bounded samples they are fitted and measured on.
    max_lists: int = 4096
    list_sample: int = 50_000
    list_questions: int = 256
    list_recall: float = 0.95


DEFAULT = Config()
