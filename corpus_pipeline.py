"""The corpus pipeline: quality, language, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null and
empty texts have no language, so the second stage rejects them at the latest. Rows that repeat an id and text are copies, of which
the third stage keeps one. Extra columns are carried to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from facetflow.llm import bpe, langid, mixing, near_dup, quality
from facetflow.llm.common import table
from facetflow.session import discard, shared_dir

REPETITION = 2.0  # times that the smallest source is used at most; the largest is used once, so nothing is left out
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the neighbour-voting classifier, learned from the labelled rows of docs, scores 0.5 or more."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels"), held_out=False))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language that holds at least three tenths of their words, learned from docs' own lang."""
    return langid.kept(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each class of copies and near copies."""
    return near_dup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the temperature mix uses it: at least once, rows of small sources up to REPETITION times. A null source is one of its own; a source of empty texts only is left out."""
    return mixing.repeated(docs, repetition=REPETITION)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; null texts are empty ones. Repeated rows give repeated rows."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each), ("mix", mixed_sources), ("encode", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and deleted once the next one is written (the last, which the result reads, stays)."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
