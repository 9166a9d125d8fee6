"""A training corpus from raw documents in five stages, each one operator on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajrisk.llm import decontamination, near_dedup, pieces, quality_rules, substring_dedup
from trajrisk.llm.common import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    model = quality_rules.train(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return near_dedup.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier place has."""
    return substring_dedup.remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    return decontamination.drop_hit(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens),
]
#: SQL has no Viterbi labelling, suffix sorting or BPE; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stored = materialize(stage(spark, docs, sf_dir), name)
        if docs is not before:  # the stored table of the stage before
            discard(docs)
        docs = stored
    return STAGES[-1][1](spark, docs, sf_dir)
