"""A corpus pipeline of five operators: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuneloom.llm import copies, decontam, langid, mixing, shards, simhash
from tuneloom.llm.common import staged, table
from tuneloom.session import stage_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    op5's fingerprints fold what is linked at 3 bits. Of what stays, all that hang together by
    sharing 0.8 or more of their five-word shingles are a group.
    """
    folded = simhash.keep_representatives(docs)
    gone = staged(spark, "gone", lambda: copies.copies_of(stage_table(folded, "folded")))
    return copies.without(folded, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's weight takes them."""
    return mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with shard and slot."""
    return shards.sharded_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing_weights),
          ("sharding", sharding)]

#: Compression and sampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
