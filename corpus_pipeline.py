"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes all rows that the stage before it wrote and hands on the columns of
``documents``; the last one returns the pieces with their token ids and their place in sequences:

1. quality_rules: documents that the base rules or the outlier test reject go;
2. near_duplicates: one document of each group of near copies stays;
3. secrets: findings are replaced by a mark in the text;
4. mixing: documents are left out, kept or repeated so that sources meet their targets;
5. packing: what is left is cut into pieces and packed into sequences of 4096 tokens.

Defined results are those of the operators: nulls, empty and very long texts, repeated
rows, empty tables and further columns pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilog.llm.mixing import mixed
from vigilog.llm.near_duplicates import deduplicated
from vigilog.llm.packing import packed_documents
from vigilog.llm.packing_query import TOKENIZER
from vigilog.llm.quality_rules import kept_rows
from vigilog.llm.secrets import redacted
from vigilog.session import stored

CAPACITY = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, TOKENIZER, capacity=CAPACITY, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: The outlier estimate, the trained models and the tokenizer have no SQL form; tests/llm/test_pipeline.py
#: holds every stage against brute force.
ORACLE_SQL = None


def packed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again: the pieces
    with their token ids and their place in sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_corpus`` without the token ids, as the query's columns are fixed."""
    return packed_corpus(spark, sf_dir).drop("ids")
