"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, fill_middle, fingerprints, jaccard_join, lm_scoring, media, mixing, packing, secrets, spelling, substring_dedup, token_counts, toxicity
from pointloom.llm.common import documents
from pointloom.llm.oracle import ORACLE_SQL


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(documents(spark, sf_dir)))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.compare_edited(documents(spark, sf_dir)))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.features(media.store(documents(spark, sf_dir))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(documents(spark, sf_dir)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir)).drop("tie")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(documents(spark, sf_dir)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), spoilt=97)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_mixing,
        op3_bpe,
        op4_secrets,
        op5_fingerprints,
        op6_media,
        op7_token_counts,
        op8_substring_dedup,
        op9_jaccard_join,
        op10_toxicity,
        op11_fill_middle,
        op12_spelling,
        op13_packing,
    )
}
