"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from facetflow.llm import ann, bpe, conversations, langid, lm, mixing, near_dup, quality, ranked, repeats, token_counts, topk, url_filter
from facetflow.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document's text by the trigram model learned from four fifths of them."""
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by votes of its labelled neighbours, learned from two thirds of the labels."""
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by Viterbi over its words, learned from three quarters of them."""
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the temperature mix uses it, with its place."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of copies and near copies of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact five best inner products of each query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine of each query vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that come earlier."""
    return repeats.digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for each benchmark item."""
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_kneser_ney, op2_neighbour_quality, op3_language_spans, op4_temperature_mix, op5_order_minhash, op6_bit_sliced_top_k, op7_one_bit_neighbours, op8_section_tokens, op9_url_filter, op10_byte_bpe, op11_conversation_repair, op12_repeated_passages, op13_ranked_search)}
ORACLES = {"op4_temperature_mix": mixing.MIX_SQL, "op6_bit_sliced_top_k": topk.TOP_K_SQL, "op9_url_filter": url_filter.verdict_sql(), "op11_conversation_repair": conversations.REPAIR_SQL, "op12_repeated_passages": repeats.REPEATS_SQL, "op13_ranked_search": ranked.RANKED_SQL}
