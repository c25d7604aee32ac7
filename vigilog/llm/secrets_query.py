"""op2: secrets in all documents. Spans have no SQL form here; checked against Python's re."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.llm.registry import query, table
from vigilog.llm.secrets import KINDS, findings, listed


@query("op2_secrets")
def op2_secrets(spark, sf_dir):
    found = findings(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
