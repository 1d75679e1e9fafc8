"""A training corpus from `documents`: each stage reads what the one before it kept.

Stages: the quality classifier drops what it rejects; exact dedup keeps the smallest doc_id of equal texts; SimHash near-dedup keeps
one document of each group; personal data is redacted; the rest is packed into sequences. All but the last return the columns of
documents. An empty table passes through all stages; nulls are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, packing, pii, quality_classifier, similar
from tidemark.llm.common import drop_intermediate, intermediate, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_near_duplicates(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), intermediate()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_intermediate(spark, start, keep=1)  # a stage's own tables, and what the one before it kept
    return STAGES[-1][1](spark, docs, sf_dir)
