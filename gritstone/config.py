"""All tunables in one place; every operator takes a Config."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # sections
    heading_min_chars: int = 3
    heading_max_chars: int = 80
    allow_terminal_punct: bool = False
    # units and chunks
    paragraph_separator: str = r"\n\s*\n"
    max_chunk_tokens: int = 256
    min_chunk_tokens: int = 20
    token_counter: str = "regex"  # or a name in functions.models.TOKEN_COUNTERS
    fragment_words: int | None = None  # words and marks of a cut sentence's pieces, whatever their tokens
    overlap_strategy: str = "last_sentence"  # or last_unit, none
    # validation
    low_info_threshold: float = 0.30
    reject_heading_only: bool = True
    min_novelty: float = 0.10
    novelty_against: str = "previous"  # the chunk before, or section: all chunks before it in its section
    keep_only_chunk: bool = False
    # vectors and search
    embedding_model: str = "hash"
    vector_size: int = 1024
    reranker_model: str = "lexical"
    vector_top_k: int = 50
    final_top_k: int = 10
    query_block: int = 1024  # queries compared at once with row_block rows
    row_block: int = 2048
    pass_queries: int = 8192  # queries that one scan of the rows answers; their vectors are sent to every task
    # approximate search
    approximate: bool = False  # search by the index, if there is one
    index_lists: int = 0  # 0: the square root of the number of rows, 4096 at most
    index_sample: int = 50_000  # vectors that the centroids are fitted to
    index_queries: int = 500  # of them, those that recall is measured with
    index_recall: float = 0.97  # of the cfg.vector_top_k nearest; decides how many lists are probed
    # storage
    table_path: str = "patent_chunks"
    batch_size: int = 100
    buckets: int = 32  # for some hundred thousand chunks; so many that one bucket is rewritten in a few minutes
    rows_per_file: int = 100_000
    max_segments: int = 8  # of upserts that are not yet merged
    fold_share: float = 0.25  # of the base's rows, from which segments are folded into it
    files_per_trigger: int = 1000  # of a stream
