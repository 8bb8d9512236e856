"""From raw documents to packed sequences: quality, language, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import langid, packing, quality, simhash, suffix
from slotcast.llm.common import table
from slotcast.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express trained models, XXH64 majorities or packing; the stages are tested against plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on all labelled documents."""
    rows = quality.training_rows(quality.measured(docs, carry=["doc_id"]), table(spark, sf_dir, "labels"), left_out=None)
    return quality.accepted(docs, quality.fit(rows))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence. It is learned from a bounded sample of the documents."""
    return langid.accepted(docs, langid.fit(docs))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.without_copies(docs, near=simhash.NEAR)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of passages of 50 words and more; documents of which nothing stays go."""
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte tokens and an end mark of every document, in sequences of up to 2048, 4096 or 8192 tokens: token ids, and where each document lies."""
    return packing.sequences(docs, F.col("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", copies_stage),
    ("repeated_passages", passages_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
