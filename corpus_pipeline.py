"""The corpus pipeline: documents in, encoded training corpus out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written
as Parquet and read again as the next stage's ``docs``. A stage's decisions take effect,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import bpe, linedup, mixing, simhash, toxicity
from pagequarry.session import stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on labelled ones, scores below the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.learn(docs, labels, toxicity.learn_fold()))


def drop_line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs of 50 words or more that occur earlier; emptied ones go."""
    return linedup.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the SimHash trie, or at 0.8 similarity of five-word shingles."""
    return simhash.keep_one(docs, simhash.similar(docs, classes=simhash.trie_classes(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each document, and digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_line_runs),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: Models and hashes of the stages have no twin in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
