"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and calls one operator on everything its
predecessor kept; all but the last return the columns of ``docs``. Tables that
a stage needs besides (labels, benchmark) come from ``sf_dir``. Stages read
their input more than once, so ``run`` keeps each result as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.llm import op01_shard, op03_mix, op04_jaccard, op06_decontaminate, op07_toxicity
from pipework.llm.common import keep, maybe_broadcast, table
from pipework.session import ship_package

#: Rejected ids up to this number are broadcast; more are shuffled.
IDS = 500_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows of rejected ids; rows with a null id stay."""
    rejected = keep(rejected.select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    return docs.join(maybe_broadcast(rejected, IDS), docs["doc_id"] == rejected["__rejected"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (score >= 0.3); rows are judged where they are read, without a shuffle."""
    ship_package(spark)
    return op07_toxicity.clean(docs, op07_toxicity.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component stays. Wholly equal rows collapse into one."""
    ship_package(spark)
    found = op04_jaccard.near_duplicates(docs)
    left = _without(docs, found.where("doc_id <> component_id"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return left.distinct() if repeated else left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship_package(spark)
    found = op06_decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has copies of it. Rows that share an id get the most copies of them."""
    ship_package(spark)
    return op03_mix.mixed(docs, exceptions=IDS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen contiguous shards of near equal bytes."""
    ship_package(spark)
    return op01_shard.shard(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Stages that train or iterate have no SQL; tests/llm compares the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
