"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.  Near duplicates are word 5-gram sets of
Jaccard similarity 0.8 or more; the smallest identifier of a group stays.  The mix repeats documents of sources below
their target, at most three times, cuts documents at the edges of blocks and targets, and lays them out in the order drawn.
Packing returns pieces of sequences.

Edge cases: null and empty texts fail the base tests of the first stage; of repeated rows one stays; texts of any length are read whole;
an empty table gives an empty result; the columns of ``documents`` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelscan.llm import exact_dedup, jaccard, mixing, packing, quality
from labelscan.llm.common import Scratch
from labelscan.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Permuted mixing over weak-supervision posteriors and packing aren't SQL; tests hold each stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
