"""The corpus pipeline (part of pointloom.llm): five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, jaccard_join, mixing, secrets, toxicity
from pointloom.llm.common import documents, free, released, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, calls toxic go; the others stay as they are.

    A null or empty text has no words and stays unless the model calls that toxic. Repeated rows share their fate; an empty table gives no rows.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model, keep=tuple(docs.columns)).where(~F.col(free("toxic", docs))).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: the one with the smallest doc_id, a null one last, and among rows of one id the one with the
    smallest hash of the text. Of rows equal in both, one. Rows without words (null and empty texts) all stay; an empty table gives no rows.
    """
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets, and n_chars follows the text: null for a null text. All rows stay."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a null source is a source, and one without words is not taken."""
    return mixing.emit(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids of every document, their digest, that of the bytes they decode to, and whether these are the
    text's. A null text has no tokens, as an empty one.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the fitted model, nor byte-level BPE; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs, before = written(stage(spark, docs, sf_dir)), docs
        if i:
            released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
