"""The corpus pipeline: stages over the documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import mixing, near_dups, packing, quality, suffixes
from changeloom.session import shared_dir

#: the vocabulary that packing reads, as (bytes, rank) lines
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule table accepts."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return near_dups.keep_one(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their 200-byte strings that occur elsewhere; emptied documents go."""
    return suffixes.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources 5, 2, 1, good documents first; a document drawn n times is n rows, all whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.written_out(mixing.mix(docs, labels=labels, whole=True))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 ids, one row per piece with its ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("repeated bytes", repeated_bytes), ("source mix", source_mix),
          ("packing", packed_windows)]

#: sketches, the greedy packing and the public vocabulary have no SQL form; the tests hold
#: every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
