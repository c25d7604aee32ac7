"""op8: quality rules over all documents. The verdict is iterative; checked against numpy."""

from __future__ import annotations

from vigilog.llm.quality_rules import judged
from vigilog.llm.registry import query, table


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
