"""Incremental intake: specification files as they arrive, as claims; domain counters kept up to date.

A page that comes again replaces its claims at the reader's side by the latest `arrived`; counters are per micro-batch sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrweave.functions import text as T


def spec_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Claims with `arrived` (the file's modification time) of files <folder>/<site>/<category>_spec.json as they appear."""
    rows = spark.readStream.schema("spec map<string,string>, url string").option("multiLine", True).option("maxFilesPerTrigger", files).json(f"{folder}/*/*_spec.json")
    path = F.col("_metadata.file_path")
    pages = rows.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("site"), F.regexp_extract(path, r"([^/]+?)_spec\.json$", 1).alias("category"), T.normalize_url(F.col("url")).alias("url"), F.col("_metadata.file_modification_time").alias("arrived"), F.explode("spec").alias("name", "value"))
    return pages.select("site", "category", "url", T.normalize_keyvalue(F.col("name")).alias("name"), T.normalize_keyvalue(F.col("value")).alias("value"), "arrived")


def domain_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Claims of each attribute by hour of arrival; hours older than the delay are closed."""
    return stream.withWatermark("arrived", delay).groupBy(F.window("arrived", "1 hour"), "site", "category", "name").agg(F.count("*").alias("size"), F.approx_count_distinct("value").alias("cardinality"))
