"""A corpus from raw documents to packed sequences. Each stage works on all that the one before kept; run() writes every
stage's result to the shared folder and reads it again, then deletes what the stage stored on its way (and nothing that others
stored).

Defined results, for every stage: null, empty and blank texts don't pass the quality rules, so later stages meet them only if
called alone, where they stay as they are; rows that repeat whole or share a doc_id, null included, are rows of their own until
near-dedup, which keeps one of each group of copies; very long texts are read whole; further columns, whatever their names, are
carried along; an empty table gives an empty one of the same columns (packing: no pieces)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import language, neardup, packing, quality, substrings
from tessitura.llm.bpe import vocabulary
from tessitura.llm.shared import forgotten, scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_quality(spark, docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language.filter_language(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (a similarity of 0.8 or more over five words) stays."""
    return neardup.keep_one(spark, docs, neardup.STAGE_PERCENT, neardup.STAGE_BANDS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across the documents left are taken out."""
    return substrings.remove_repeats(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(spark, docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack_sequences),
]

#: SQL can express neither the automata nor the tokens; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as own:
            out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        forgotten(spark, [*own, f"{folder}/{k - 1}"] if k else own)
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
