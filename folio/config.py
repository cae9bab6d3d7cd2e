"""Parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes in tokens of the counter in use, counts, and vector width."""

    chunk_size: int = 800
    chunk_overlap: int = 200
    chunk_context: int = 1500
    min_summary_words: int = 50
    max_hints: int = 5
    large_section_tokens: int = 4000
    deepest_level: int = 8
    vector_width: int = 1536
    embed_batch: int = 40
