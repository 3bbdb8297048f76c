"""The corpus pipeline: from documents to token digests of a deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm import bpe_tree, digest_index, language_id, lsh_forest, mixing
from docflow.plans.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language that the model knows go."""
    return language_id.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest doc_id stays."""
    return digest_index.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of five-word shingles, the one with the least doc_id stays."""
    return lsh_forest.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by systematic sampling to the sources' target weights."""
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document of the mix."""
    return bpe_tree.op6_bpe_tree(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

#: Language ID and near-duplicate links are not for SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's rows staged as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
