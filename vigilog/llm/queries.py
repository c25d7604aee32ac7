"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from vigilog.llm import bpe_query, classifier_query, html_text_query, licenses_query, mixing_query, near_duplicate_query, packing_query, prefix_trie_query, quality_rules_query, ranked_search_query, repeats_query, secrets_query, top_k_query  # noqa: F401
from vigilog.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
