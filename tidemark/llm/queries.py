"""All queries of this subpackage, each registered in the module of its operator."""

from tidemark.llm import (  # noqa: F401  (importing registers the queries)
    decontaminate, html_text, infill, jaccard, licenses, ngram_lm, packing, ranked, similarity_digest, substring,
    token_count, toxicity, vectors,
)
from tidemark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
