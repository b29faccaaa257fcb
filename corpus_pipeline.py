"""A corpus pipeline over the training-data operators: toxicity, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import packing, quality, simhash, toxicity
from quern.llm.common import saved, table
from quern.llm.queries import GOOD, TOXIC, quality_labels, toxic_labels, word_vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, toxic_labels(spark, sf_dir)), TOXIC)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, quality_labels(spark, sf_dir)), GOOD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: of the smallest doc_id, and of its rows one of them."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 ids."""
    return packing.pack(docs, word_vocabulary())


STAGES: list = [("toxicity", without_toxic), ("quality", good), ("simhash", one_of_each), ("packing", packed)]
#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
