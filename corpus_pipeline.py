"""Corpus pipeline: five stages from documents to shards, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from halocline.llm import classifier, decontam, minhash, mixing, shards
from halocline.llm.common import table, unwritten, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts (operator 7)."""
    judged = classifier.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), whole=True)
    return judged.where("__kept").drop("__kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group (operator 4), five-word shingles at 0.8; rows that repeat its id and text go.

    Documents without an id, or with one that another text has too, are grouped by their own sets, after those with an id of their own.
    """
    keyed = with_key(docs)
    groups = minhash.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
    kept = groups.where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return keyed.join(kept, F.col("__key") == F.col("__id"), "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def with_key(docs: DataFrame) -> DataFrame:
    """docs with __key: the id, or where it's null or a second text has it, a number from 2**61 up by id and text."""
    own = F.xxhash64("text")
    texts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__shared")).agg(F.min(own).alias("__lo"), F.max(own).alias("__hi"))
    shared = written(texts.where("__lo < __hi").select("__shared", "__lo"), "shared")
    if shared.count() <= classifier.BROADCAST_ROWS:
        shared = F.broadcast(shared)
    other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**61 - 1)).bitwiseOR(F.lit(2**61))
    key = F.when(F.col("doc_id").isNull() | (F.col("__lo").isNotNull() & (own != F.col("__lo"))), other).otherwise(F.col("doc_id"))
    return docs.join(shared, F.col("doc_id") == F.col("__shared"), "left").withColumn("__key", key).drop("__shared", "__lo")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item (operator 3)."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources asks for (operator 6)."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to shards (operator 5)."""
    return shards.with_shard(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier of the first stage is trained, which SQL can't express; tests hold every stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage reads in the shared folder goes once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        docs = written(result, name)
        unwritten(result)
