"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and gives a DataFrame; ``run`` writes it as Parquet to shared storage and reads
it back for the next.  All stages but the last return the columns of documents.

Rows with null or empty texts are judged like all others: the first two stages
keep one of them, and they are packed as a lone end id.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm import decontam, exact_dedup, jaccard, packing, quality
from tarnflow.llm.shared import table, written
from tarnflow.llm.tokens import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on trusted ones of these, does not reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarity the one with the smallest id."""
    return jaccard.one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Models and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
