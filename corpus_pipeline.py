"""From raw documents to token digests: the stages of the training-data pipeline, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import bpe_tree, line_dedup, order_minhash, quality_gam, source_mix
from echofold.llm.common import discard, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 0 for go."""
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, from all of them; every document stays."""
    return line_dedup.without_common_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return order_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return source_mix.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix."""
    return bpe_tree.token_digests(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near), ("source mix", mix), ("byte-level BPE", tokens)]
#: SQL can express neither the classifier nor the near-duplicates; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written as Parquet and read again, the one before it deleted."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return docs
