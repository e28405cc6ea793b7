"""The queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe, fingerprint, importance, langid, licenses, maglev, mixing, neardup, repetition
from .common import documents
from .oracles import oracles

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, share = importance.target_sample(documents(spark, sf_dir, "labels"))
    return importance.resample(documents(spark, sf_dir), keys, share)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.add_repetition_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return found.drop("text")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=4)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.deal_shards(documents(spark, sf_dir), SHARDS)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = langid.learn_dictionaries(docs.where(~held_out()))
    found = langid.identify_languages(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), copy="copy")


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.backoff_scores(documents(spark, sf_dir))
    return found.withColumns({"log_score": F.round("log_score", 4), "mean_log": F.round("mean_log", 6)})


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_importance, op2_repetition, op3_neardup, op4_shards, op5_langid, op6_mixing, op7_backoff, op8_fingerprint, op9_licenses, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return oracles(SHARDS)
