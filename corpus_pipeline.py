"""Corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, decontamination, mixing.

A stage function's result must be written before the next one is called: the working tables of a stage are
deleted when the next begins, so the shared folder holds those of one stage at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, jaccard, mixing, rules, suffix
from quern.sources.stage import drop_stages, stage, staged

#: A passage of more than 50 words that repeats has at least so many bytes, at five a word; grams a fifth of it.
PASSAGE, PASSAGE_GRAM = 250, 50
#: A document goes with its first window of a benchmark item, whatever its length.
LEAK_SHARE = 0.0

_working: set[str] = set()


def working(step: Callable) -> Callable:
    """Deletes the working tables of the stage before, and notes those of this one."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stages(_working)
        before = staged()
        try:
            return step(spark, docs, sf_dir)
        finally:
            _working.clear()
            _working.update(staged() - before)

    return run_step


@working
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


@working
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


@working
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs, PASSAGE, PASSAGE_GRAM)


@working
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAK_SHARE)


@working
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate), ("mixing sources", mix)]

#: Suffix matches and linked components of all documents are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before = docs
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"), [before])
    return docs
