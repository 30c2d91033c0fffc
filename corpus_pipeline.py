"""Corpus pipeline: documents through quality filter, exact and near dedup, source mixing and packing.

Each stage works on all rows that the one before kept; its result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorledger.llm.common import staged, table
from floorledger.llm.exact_dedup import keep_first
from floorledger.llm.minhash_dedup import keep_one
from floorledger.llm.mixing import repeat_rows
from floorledger.llm.packing import pack
from floorledger.llm.quality_fm import keep_good
from floorledger.llm.queries import MAX_REPEATS, SEQUENCE_TOKENS, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), cut=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs, percent=85)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to ``MAX_REPEATS`` times."""
    return repeat_rows(docs, max_repeats=MAX_REPEATS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: Learned models, shingle hashes and a tokenizer are part of it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
