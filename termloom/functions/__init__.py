from termloom.functions.text import analyze, analyze_with_offsets, candidate_text, raw_tokens
from termloom.functions.vector import cosine, dot, norm

__all__ = [
    "analyze",
    "analyze_with_offsets",
    "candidate_text",
    "cosine",
    "dot",
    "norm",
    "raw_tokens",
]
