"""op10: quality scores of all documents, learned from labels outside a third held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilog.llm.classifier import fitted, scored
from vigilog.llm.registry import query, table


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fitted(docs, table(spark, sf_dir, "labels"), learn=part != 1)
    rows = scored(docs, model)
    return rows.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
