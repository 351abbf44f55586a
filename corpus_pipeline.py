"""A corpus from raw documents to training shards, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator.  All stages but
the last return the columns of ``documents``; the last writes token shards and returns a row for each sequence.

Null and empty texts, null ids and repeated rows are kept by the classifier's score of a text without words, are one class
of near-duplicates where they have no words, are never contaminated, count no words in the mix, and give a sequence with
the end id alone.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procspark.llm import decontam, mixing, simhash, tokens, toxicity
from procspark.llm.common import Scratch, read, scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactually regularised classifier doesn't reject."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages beyond a twentieth of their words."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.replicate(mixing.mix(docs))


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row for each sequence, read back from the shards."""
    path = scratch_dir(spark)
    tokens.materialise(docs, path)
    return tokens.digest(tokens.read_shards(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_shards),
]

#: Neither the classifier nor XXH64 or the tokenizer can be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
