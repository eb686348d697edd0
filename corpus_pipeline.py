"""A corpus pipeline over `documents`: toxicity, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows the next one works on; all but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaline.llm import bpe, mixing, neardup, substrings, toxicity
from tessaline.llm.base import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(spark, docs, sf_dir)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("repeated passages", without_repeated_passages),
    ("mixing", mixed),
    ("byte-level BPE", tokenized),
]

#: The lexicon is learned and the mix drawn from hashes: no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
