"""Constants of retrieval and evaluation."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values of the retrieval system that results must equal.
    search_results: int = 20
    abstracts_kept: int = 6
    top_k: int = 8
    relevance: float = 0.8
    hybrid_weight: float = 0.5
    mmr_lambda: float = 0.7
    pool_factor: int = 4
    pool_least: int = 16
    pool_most: int = 64
    window_tokens: int = 700
    overlap_tokens: int = 150
    chars_per_token: int = 4
    pack_tokens: int = 900
    carry_tokens: int = 78
    section_tokens: int = 1500
    least_chars: int = 50
    semantic_similarity: float = 0.75
    context_tokens: int = 8192
    answer_tokens: int = 2048
    prompt_tokens: int = 1000
    resamples: int = 10_000
    seed: int = 42


SETTINGS = Settings()

#: The chunking strategies with their labels, in the order that breaks ties.
STRATEGIES = {
    "STRUCTURE_AWARE_OVERLAP": "Structure-Aware Overlap",
    "SEMANTIC_PARAGRAPH_GROUPING": "Semantic Paragraph Grouping",
    "FIXED_WINDOW_OVERLAP": "Fixed Window Overlap",
    "SECTION_LEVEL_CHUNKING": "Section-Level Chunking",
}
