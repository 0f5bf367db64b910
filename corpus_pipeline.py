"""A corpus from raw documents: rejects of the quality network go, exact and near copies go, sources are mixed, and
the rest is encoded. Every stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import bagminhash, common, cuckoo, mixing, pieces, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(docs, common.read(spark, sf_dir, "labels"))
    return common.with_ids(docs, scored.where("predicted = 1"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cuckoo.keep_one_of_each(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return common.with_ids(docs, bagminhash.near_duplicates(docs).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return common.with_ids(docs, mixing.mixed(docs, mixing.TARGETS, share=mixing.KEPT_SHARE).where("kept"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_table(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores, minhashes and raked weights have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage drops a row by its doc_id: rows that share an id stay or go together. A stage's table is deleted once
    the next one is written.
    """
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = before = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}", instead_of=before)
    return docs
