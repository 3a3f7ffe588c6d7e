"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (op01_shard, op02_chat, op03_mix, op04_jaccard, op05_substrings, op06_decontaminate, op07_toxicity,
               op08_quality, op09_language, op10_exact, op11_topk, op12_alignment, op13_trie)
from .common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_shard.shard(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_mix.mix(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op02_chat.with_probe(table(spark, sf_dir, "conversations"))
    return op02_chat.digest(op02_chat.format_chats(rows))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_substrings.cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_language.language_id(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_exact.exact_groups(table(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_topk.top_k(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_alignment.digest(op12_alignment.alignment(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_shard, op2_chat, op3_mix, op4_ngram_jaccard, op5_suffix_dedup, op6_decontaminate, op7_toxicity,
                                  op8_quality, op9_language, op10_exact_dedup, op11_topk_search, op12_token_alignment, op13_prefix_trie)}
ORACLE = {"op2_chat": op02_chat.SQL, "op4_ngram_jaccard": op04_jaccard.SQL, "op6_decontaminate": op06_decontaminate.SQL, "op10_exact_dedup": op10_exact.SQL,
          "op11_topk_search": op11_topk.SQL, "op13_prefix_trie": op13_trie.SQL}
