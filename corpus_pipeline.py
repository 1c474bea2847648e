"""The corpus pipeline: documents in, training tokens out. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attrweave.llm import bpe, langid, mixing, simhash, suffix
from attrweave.llm.common import shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return langid.filter_languages(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with or without an id of its own."""
    return simhash.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each repeated passage the first occurrence."""
    return suffix.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came, all sources alike in number; a document may come more than once."""
    return mixing.mix(docs, copy="__aw_copy").drop("__aw_copy")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("suffix_array_dedup", repeat_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: The stages aren't expressible in SQL as a whole; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
