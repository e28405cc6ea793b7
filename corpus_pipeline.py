"""From raw documents to token ids: five stages, each written as Parquet and read again.

The first four return the columns of their input; the last one the token
digests of each remaining row. Rows with null or blank texts go in the first
stage; an empty table passes all stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from entrywise.llm import bpe, common, langid, mixing, neardup, registry, repetition


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_unrepetitive(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn_dictionaries(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, registry.tokenizer_path())


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near dedup", near_dedup), ("mixing", mix), ("bpe", tokenize)]

#: The compression classifier and the sketches have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; it goes with the application."""
    path = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    common.delete_at_end(spark, path)
    return path


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            common.delete_now(spark, f"{folder}/{k - 1}")
    return docs
