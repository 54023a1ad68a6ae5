"""Pipeline over documents: quality rules, near-duplicate removal, personal data, source mixing, packing.

Each stage works on every row its predecessor kept and returns the columns of documents; the last one returns packed
pieces. Null texts fail the quality rules, an empty table stays empty, and extra columns travel along unchanged.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import mixing, neardup, packing, pii, quality
from barloom.llm.common import collected, drop_tables, table, written
from barloom.llm.queries import vocabulary


#: Words whose ids a Python worker keeps: fewer than in a job of packing alone, as the workers of all stages stay alive.
MEMO_WORDS = 100_000

#: Tables of the stage that ran last; its result is written before the next stage starts.
_made: list[str] = []


def staged(stage):
    """Drop the tables of the stage before, whose result is written by now, and keep note of this stage's own."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _made)
        with collected(_made):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their stratum's certified cutoffs."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.without_copies(docs, k=5, percent=80)


@staged
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    return pii.masked(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


@staged
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048; a document taken twice is packed twice."""
    return packing.digest(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048, memo_words=MEMO_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packed),
]
#: Certified cutoffs, MinHash classes, EM labels and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
