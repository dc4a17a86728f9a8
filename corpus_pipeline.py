"""The training-data pipeline: language ID, exact and near duplicates, mixing, encoding.

Each stage reads what its predecessor kept, and its decisions take effect: documents without a
language go, one document of each group of equal texts and of near copies stays, sources are
mixed to their targets (a document may come several times, or not at all), and every row of the
mix is encoded in sampled segmentations. All but the last return the columns of their input.

Every stage's result is written to the shared folder and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_sampling
from ticketlens.llm.common import table
from ticketlens.operators.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; null text and text without a letter go."""
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    return language_id.kept_documents(docs, language_id.learn(labelled))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, sample, ids, log_prob, inclusion and round_trip of every row of the mix."""
    return sentencepiece_sampling.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language models and sampled segmentations are beyond SQL; the tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
