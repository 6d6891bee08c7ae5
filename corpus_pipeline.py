"""From raw documents to packed sequences, in five stages; each takes and returns a table like ``documents``
(the last one: pieces of sequences) that is written as Parquet in between.

Defined results: a null text counts as empty, so the first stage drops it; empty texts and texts of white space go there as well.
Repeated rows are judged alike, and one of them stays after the second stage. Null ids are ids of their own that lose ties; null
languages and sources are a leaf of their own. Very long texts are read whole. Columns other than the five of ``documents`` are
carried along by all stages but the last, whatever their names. An empty table gives an empty table in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litspark.llm import op2_quality_rules, op5_exact_dedup, op6_ngram_join, op8_mixing, op10_packing
from litspark.llm.common import table, written

#: Near copies of the corpus: shingles of five words, a similarity of 0.8 or more (the op6 query's contract has its own).
NEAR_WORDS = 5
NEAR_PERCENT = 80
#: Share of the tokens that reach the mixture which it keeps.
MIX_PERCENT = 70
#: What a packing worker keeps at once: other stages' memory is still with the executor when packing begins.
PACK_MEMO_UNITS = 60_000
PACK_BLOCK_BYTES = 1 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labelling reject go."""
    model = op2_quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return op2_quality_rules.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return op5_exact_dedup.deduplicate(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return op6_ngram_join.representatives(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A one-epoch mixture to the target weights."""
    return op8_mixing.mixed(docs, MIX_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return op10_packing.pack(docs, memo_units=PACK_MEMO_UNITS, block_bytes=PACK_BLOCK_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Stages 1 and 3 aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
