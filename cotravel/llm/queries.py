"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import url_reputation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, spans

    return digest(spans(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, fit

    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_token_orc": op6_token_orc,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_hnsw": op9_hnsw,
    "op10_url_reputation": op10_url_reputation,
}

ORACLES: dict[str, str] = {"op10_url_reputation": url_reputation.ORACLE}
