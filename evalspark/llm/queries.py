"""The registered queries of the subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bagminhash, cuckoo, egojoin, lexical, licenses, mixing, pieces, quality, suffix, toxicity, urls, windows
from .common import read


def op1_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_substrings(read(spark, sf_dir, "documents")).drop("spans")


def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"), mixing.TARGETS, share=mixing.KEPT_SHARE)


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_table(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op8_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(read(spark, sf_dir, "documents"))


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))[0]


def op12_document_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cuckoo_dedup, op2_suffix_dedup, op3_byte_cnn_quality, op4_raked_mixing, op5_ordinal_toxicity,
        op6_viterbi_pieces, op7_url_filter, op8_ego_join, op9_bagminhash, op10_compact_windows, op11_fragment_alignment, op12_document_tree_search, op13_license_automaton,
    )
}
