"""A corpus pipeline: each stage reads what the one before it kept.

quality (junk goes) -> exact duplicates (the largest doc_id stays) -> near-duplicates (five-word shingles, similarity
0.8 or more; the smallest doc_id of a group stays) -> personal data (generalised or removed in the text) -> packing
into sequences of 1024 tokens. `run` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import best_fit_packing, exact_dedup, ngram_join, pii, quality
from tidewright.llm.runtime import Table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds likelier to be junk than not go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, n=5, similarity=Fraction(4, 5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: No SQL twin: the classifier, the tokenizer and the packing cannot be written in SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Table(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return docs
