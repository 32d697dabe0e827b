"""A training corpus from ``documents``: filter, remove copies and repeats, decontaminate, pack.

Each stage gets what its predecessor kept, written as Parquet in the shared
folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levelforge.llm.common import materialise, table
from levelforge.llm.decontaminate import without_contaminated
from levelforge.llm.packing import pack, token_pieces
from levelforge.llm.quality import apply_quality
from levelforge.llm.queries import WORD_TOKENIZER, tokenizer_path
from levelforge.llm.simhash import keep_one
from levelforge.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits of their host go from the others."""
    return apply_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    return keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id holds go from the texts."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences of 2048 tokens."""
    return pack(token_pieces(docs, tokenizer_path(WORD_TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeat_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Fingerprints and tokens are beyond SQL: tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
