"""op1: all documents packed into sequences of 4096 tokens. Checked against brute force."""

from __future__ import annotations

import public_tokenizers

from vigilog.llm.packing import packed_documents
from vigilog.llm.registry import query, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    rows = packed_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1, keep_ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
