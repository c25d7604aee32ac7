"""op11: ids of all documents by a byte-level vocabulary, and the texts that the ids stand for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vigilog.llm.bpe import decoded, encoded
from vigilog.llm.registry import query, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op11_bpe")
def op11_bpe(spark, sf_dir):
    rows = decoded(encoded(table(spark, sf_dir, "documents"), TOKENIZER), TOKENIZER)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
