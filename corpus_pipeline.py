"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from treeloom.llm.common import drop_kept, keep, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled shards: the documents' columns, then shard and slot."""
    return sharding.shards(docs).select("row.*", "shard", "slot")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: SQL cannot express the toxicity model nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each written and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_kept(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
