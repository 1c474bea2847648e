"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrweave.llm import bpe, embeddings, hostrules, html, langid, mixing, sharding, simhash, suffix, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a response and, from a later crawl, as a revisit that knows the digest alone."""
    first = warc.captures(_table(spark, sf_dir, "pages"))
    shift = (first.agg(F.max("record_id")).first()[0] or 0) + 1
    later = first.select((F.col("record_id") + shift).alias("record_id"), "url", F.lit(None).cast("binary").alias("payload"), "digest", F.lit(warc.LATER).alias("date"))
    return warc.write_archives(first.unionByName(later)).drop("file", "offset", "length")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document that it shows; the trees learn from some of those."""
    pages = _table(spark, sf_dir, "pages")
    link = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) as long)")
    return html.extract(pages, html.train(pages, _table(spark, sf_dir, "documents"), link))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(_table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(_table(spark, sf_dir, "documents"))


def op9_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_copies(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_host_rules": op8_host_rules,
    "op9_embedding_copies": op9_embedding_copies,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": warc.SQL, "op6_mixing": mixing.SQL, "op8_host_rules": hostrules.SQL, "op9_embedding_copies": embeddings.SQL}
