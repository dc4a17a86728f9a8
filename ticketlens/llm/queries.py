"""Registered queries of the training-data operators and, where SQL can state them, their twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    exact_dedup,
    html_extraction,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    nearest,
    prefix_trie,
    quality_rules,
    ranked_search,
    sentencepiece_sampling,
    sharding,
    token_counts,
)
from ticketlens.llm.common import table
from ticketlens.operators.staging import shared_root

SHARDS = 8


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own per call, so that a call shows the whole work.
    cache = f"{shared_root(spark)}/token-cache-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), cache)
    token_counts.delete_cache(spark, cache)
    return counted


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_sampling.encode(table(spark, sf_dir, "documents"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    spans = language_id.identify(docs, language_id.learn(seen))
    return spans.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    convs, rebuilt = prefix_trie.rebuilt(turns, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)
    return prefix_trie.nodes(convs, rebuilt)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_nearest": op13_nearest,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece_sampling": op6_sentencepiece_sampling,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
}
