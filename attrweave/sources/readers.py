"""Readers: specifications, linkage, ground truths and results of earlier runs, all as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T


def _path() -> Column:
    return F.col("_metadata.file_path")


def _site(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _category(path: Column, ending: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+?){ending}\.json$", 1)


def specs(spark: SparkSession, folder: str, category: str = "*", site: str = "*", normalize_values: bool = True) -> DataFrame:
    """Claims (site, category, url, name, value, raw_value) of <folder>/<site>/<category>_spec.json.

    Urls and names are normalised; of names that agree on a page the last wins, a later page of the same url over an earlier.
    """
    rows = spark.read.schema("spec map<string,string>, url string").option("multiLine", True).json(f"{folder}/{site}/{category}_spec.json")
    # Where a page stands in its file: files are read whole by one task, in order.
    pages = rows.select(_site(_path()).alias("site"), _category(_path(), "_spec").alias("category"), T.normalize_url(F.col("url")).alias("url"), F.monotonically_increasing_id().alias("page"), "spec")
    each = pages.select("site", "category", "url", "page", F.posexplode(F.map_entries("spec")).alias("at", "entry"))
    named = each.select("site", "category", "url", "page", "at", T.normalize_keyvalue(F.col("entry.key")).alias("name"), F.col("entry.value").alias("raw_value"))
    w = Window.partitionBy("site", "category", "url", "name").orderBy(F.col("page").desc(), F.col("at").desc())
    once = named.filter("raw_value is not null").withColumn("k", F.row_number().over(w)).filter("k = 1")
    value = T.normalize_keyvalue(F.col("raw_value")) if normalize_values else F.col("raw_value")
    return once.select("site", "category", "url", "name", value.alias("value"), "raw_value")


def linkage(spark: SparkSession, folder: str, category: str = "*", suffix: str = "", check: bool = True) -> DataFrame:
    """Rows (pid, site, category, url) of <folder>/<site>/<category>_linkage<suffix>.json; a pid twice in a file is an error."""
    raw = spark.read.text(f"{folder}/*/{category}_linkage{suffix}.json", wholetext=True).select(_site(_path()).alias("site"), _category(_path(), f"_linkage{suffix}").alias("category"), "value")
    if check:
        keys = F.json_object_keys("value")
        twice = raw.filter(F.size(keys) > F.size(F.array_distinct(keys))).select("site").limit(1).collect()
        if twice:
            raise ValueError(f"a pid occurs twice in the linkage of {twice[0][0]}")
    rows = raw.select("site", "category", F.explode(F.from_json("value", "map<string,array<string>>")).alias("pid", "urls"))
    each = rows.select("pid", "site", "category", F.explode("urls").alias("url"))
    return each.select("pid", "site", "category", T.normalize_url(F.col("url")).alias("url")).distinct()


def global_linkage(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pid, category, url) of one file {pid: {category: [url]}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    one = raw.select(F.explode("m").alias("pid", "by")).select("pid", F.explode("by").alias("category", "urls"))
    each = one.select("pid", "category", F.explode("urls").alias("url"))
    return each.select("pid", "category", T.normalize_url(F.col("url")).alias("url")).distinct()


def source_order(spark: SparkSession, path: str) -> DataFrame:
    """Rows (place, site, category) of lines site__category, the most linked first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")).filter("trim(line) <> ''")
    return lines.select("place", F.split_part("line", F.lit("__"), F.lit(1)).alias("site"), F.split_part("line", F.lit("__"), F.lit(2)).alias("category"))


def spec_files(spark: SparkSession, folder: str) -> int:
    return spark.read.format("binaryFile").load(f"{folder}/*/*_spec.json").select("path").count()


def csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    rows = spark.read.option("header", header is None).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*header) if header else rows


def schema_truth(table: DataFrame, cid: str = "cluster_id_real") -> DataFrame:
    """Rows (node, source, name, cid) of a ground truth or an earlier cluster_detail: names are normalised, virtual attributes
    count as their original, rows without a cluster are left out."""
    name = T.original_name(T.normalize_keyvalue(F.col("name")))
    rows = table.filter(F.col(cid).isNotNull() & (F.trim(F.col(cid).cast("string")) != ""))
    return rows.select(F.concat_ws("//", "source", name).alias("node"), "source", name.alias("name"), F.col(cid).cast("string").alias("cid")).distinct()


def instance_truth(table: DataFrame) -> DataFrame:
    """Rows (site, url, name, target) of a ground truth by instance."""
    return table.select(F.col("SOURCE_NAME").alias("site"), T.normalize_url(F.col("URL")).alias("url"), T.normalize_keyvalue(F.col("ATTRIBUTE_NAME")).alias("name"), F.col("TARGET_ATTRIBUTE_ID").alias("target")).distinct()


def heterogeneous(truth: DataFrame) -> DataFrame:
    """Attributes (site, name) whose provenances have more than one set of targets."""
    sets = truth.groupBy("site", "url", "name").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return sets.groupBy("site", "name").agg(F.countDistinct("targets").alias("sets")).filter("sets > 1").select("site", "name")


def ikgpp(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pid, target, site, url, name, value) of an instance-level graph {pid: {target: ["site#-#url/name=value"]}}; the
    older form is site/name=value."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("pid", "by")).select("pid", F.explode("by").alias("target", "all")).select("pid", "target", F.explode("all").alias("p"))
    place = F.split_part("p", F.lit("="), F.lit(1))
    site = F.when(place.contains(T.SEPARATOR), F.substring_index(place, T.SEPARATOR, 1)).otherwise(F.substring_index(place, "/", 1))
    rest = F.when(place.contains(T.SEPARATOR), F.regexp_extract(place, r"^.*?#-#(.*)/[^/]*$", 1)).otherwise(F.regexp_extract(place, r"^(.*)/[^/]*$", 1))
    return rows.select("pid", "target", site.alias("site"), rest.alias("url"), F.substring_index(place, "/", -1).alias("name"), F.split_part("p", F.lit("="), F.lit(2)).alias("value"))


def key_values(spark: SparkSession, path: str, domains: DataFrame | None = None) -> DataFrame:
    """Claims of a web corpus of JSON lines {id, category, cluster_id, keyValuePairs}: records without a category or pairs are
    left out; the site is the registered domain of the record, if there is a table (id, domain)."""
    rows = spark.read.schema("id long, category string, cluster_id long, keyValuePairs map<string,string>").json(path).filter("category is not null and keyValuePairs is not null")
    if domains is not None:
        rows = rows.join(domains, "id")
    else:
        rows = rows.withColumn("domain", F.lit("unknown"))
    return rows.select(F.col("domain").alias("site"), "category", F.concat_ws("//", "domain", F.col("id").cast("string")).alias("url"), F.col("cluster_id").cast("string").alias("pid"), F.explode("keyValuePairs").alias("name", "value"))


def registered_domain(url: Column) -> Column:
    """The last two labels of a url's host, three where the second last is a general one (co.uk)."""
    host = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z]+://)?([^/?#:]+)", 1), r"^www\.", "")
    return F.regexp_extract(host, r"([^.]+\.(?:(?:co|com|org|net|gov|ac)\.)?[^.]+)$", 1)


def split_ids(table: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Columns for the parts of ids like a//b//c."""
    return table.select("*", *[F.split_part(F.col(column), F.lit("//"), F.lit(k + 1)).alias(p) for k, p in enumerate(parts)])


READERS = {"FILE": specs, "KEY_VALUES": key_values}


def lookup(rows: DataFrame, urls: list[str] | None = None, pids: list[str] | None = None) -> DataFrame:
    """The rows of a global linkage of some urls (normalised first) or of some entities."""
    if urls is not None:
        spark = rows.sparkSession
        wanted = spark.createDataFrame([(u,) for u in urls], "asked string").select(T.normalize_url(F.col("asked")).alias("url")).distinct()
        rows = rows.join(wanted, "url", "left_semi")
    return rows if pids is None else rows.filter(F.col("pid").isin(pids))


def lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows (file, line) of the text files of a pattern."""
    return spark.read.text(pattern).select(F.regexp_extract(_path(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("line"))


def csv_map(spark: SparkSession, path: str, key: str, value: str, multi: bool = False) -> DataFrame:
    """Rows (key, value) of two columns of a CSV file: one value for a key, the least, or the sorted array of all."""
    rows = csv(spark, path).select(F.col(key).alias("key"), F.col(value).alias("value"))
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("value") if multi else F.min("value").alias("value"))
