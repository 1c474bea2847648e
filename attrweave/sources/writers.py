"""Writers: reports, the instance-level graph, specifications and tables for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators.claims import SA, sizes, top_values
from attrweave.operators.stats import linked_pages


def csv(table: DataFrame, path: str, first: list[str] = (), mode: str = "errorifexists") -> None:
    """Columns in the order of `first`, then by alphabet; those of `first` that are missing are empty."""
    names = [*first, *sorted(set(table.columns) - set(first))]
    table.select(*[F.col(f"`{c}`") if c in table.columns else F.lit("").alias(c) for c in names]).write.mode(mode).option("header", True).csv(path)


def json(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)])).alias("value")).write.mode(mode).text(path)


def cluster_synthesis(clustered: DataFrame, names: DataFrame) -> DataFrame:
    """cluster_id, number_attributes and the cluster's names; names: cid, names (array)."""
    n = clustered.groupBy("cid").agg(F.count("*").alias("number_attributes"))
    return n.join(names, "cid", "left").select(F.col("cid").alias("cluster_id"), "number_attributes", *[F.coalesce(F.try_element_at("names", F.lit(k)), F.lit("")).alias(f"Name{k}") for k in (1, 2, 3)])


def cluster_detail(clustered: DataFrame, claims: DataFrame, linkage: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """A row for each attribute: its cluster (ISOLATED_i if none), size, most frequent values, cardinality, occurrences, linked
    pages. clustered: cid, site, category, name; deleted ones have no cluster id."""
    top = top_values(claims.withColumn("value", F.col("raw_value")) if "raw_value" in claims.columns else claims, 3)
    best = top.groupBy(*SA).agg(*[F.coalesce(F.max(F.when(F.col("place") == k, F.concat(F.col("value").cast("string"), F.lit("#"), F.col("occs").cast("string")))), F.lit("")).alias(f"Top{k}") for k in (1, 2, 3)])
    count = clustered.groupBy("cid").agg(F.count("*").alias("cluster_size"))
    rows = sizes(claims).join(best, SA).join(clustered, SA, "left").join(count, "cid", "left").join(linked_pages(claims, linkage), SA, "left")
    if deleted is not None:
        rows = rows.join(deleted.select(*SA, F.lit(True).alias("gone")), SA, "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("boolean"))
    lonely = F.col("cid").isNull() & F.col("gone").isNull()
    # Numbers of isolated attributes are by name, counted inside a source and not over all.
    number = F.row_number().over(Window.partitionBy("site", "category", lonely).orderBy("name"))
    cid = F.when(F.col("gone"), F.lit(None).cast("string")).when(F.col("cid").isNotNull(), F.col("cid").cast("string")).otherwise(F.concat(F.lit("ISOLATED_"), "site", F.lit("_"), number.cast("string")))
    source = F.concat_ws("__", "site", "category")
    return rows.select(cid.alias("cluster_id"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"), source.alias("source"), F.concat_ws("/", source, "name").alias("full_name"), "Top1", "Top2", "Top3", "cardinality", F.col("size").alias("occurrences"), "name", F.coalesce("linked_pages", F.lit(0)).alias("LINKED_PAGES"))


def instance_graph(claims: DataFrame, linkage: DataFrame, clustered: DataFrame, labels: DataFrame, isolated: bool = False) -> DataFrame:
    """Rows (pid, target, provenances): sorted `site#-#url/name=value` of each linked entity and cluster; target is
    `label__cid`. Virtual attributes show their original; isolated: those without a cluster are their own targets."""
    met = claims.join(clustered, SA, "left" if isolated else "inner").join(labels, "cid", "left")
    target = F.when(F.col("cid").isNotNull(), F.concat_ws("__", F.coalesce("label", F.lit("")), F.col("cid").cast("string"))).otherwise(F.concat(F.lit("ISOLATED_"), F.concat_ws("//", "site", "name")))
    shown = T.original_name(F.col("name"))
    rows = met.join(linkage, ["site", "category", "url"]).select("pid", target.alias("target"), "site", "url", shown.alias("shown"), F.col("value").cast("string").alias("value"))
    once = rows.groupBy("pid", "target", "site", "url", "shown").agg(F.min("value").alias("value"))
    prov = F.concat("site", F.lit(T.SEPARATOR), "url", F.lit("/"), "shown", F.lit("="), "value")
    return once.groupBy("pid", "target").agg(F.array_sort(F.collect_list(prov)).alias("provenances"))


def instance_level(clustered: DataFrame, claims: DataFrame, atomic: DataFrame) -> DataFrame:
    """Of each cluster its values, its atomic attributes and the originals of the others, as sorted arrays."""
    node = F.concat_ws("//", "site", "name")
    rows = claims.join(clustered, SA).join(atomic, SA, "left")
    collect = lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    yes = F.coalesce("atomic", F.lit(False))
    return rows.groupBy("cid").agg(collect(F.lit(True), F.col("value").cast("string")).alias("values"), collect(yes, node).alias("atomic"), collect(~yes, F.concat_ws("//", "site", T.original_name(F.col("name")))).alias("non_atomic"))


def specs(claims: DataFrame, path: str) -> None:
    """Claims as JSON lines {spec, url} in folders by site and category."""
    pages = claims.groupBy("site", "category", "url").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("value").cast("string"))))).alias("spec"))
    pages.write.partitionBy("site", "category").json(path)


def linkage(table: DataFrame, path: str) -> None:
    table.groupBy("site", "category", "pid").agg(F.array_sort(F.collect_set("url")).alias("urls")).write.partitionBy("site", "category").json(path)


def long_table(claims: DataFrame, links: DataFrame) -> DataFrame:
    """pid, source, url, name, value, additional: whether it is a further entity of the page."""
    w = Window.partitionBy("site", "category", "url").orderBy("pid")
    numbered = links.withColumn("additional", F.row_number().over(w) > 1)
    return claims.join(numbered, ["site", "category", "url"], "left").select("pid", F.concat_ws("__", "site", "category").alias("source"), "url", "name", "value", F.coalesce("additional", F.lit(False)).alias("additional"))


def pivoted(claims: DataFrame, site: str, category: str, names: list[str] | None = None) -> DataFrame:
    """A source as a table: a row for each page, a column for each attribute."""
    rows = claims.filter((F.col("site") == site) & (F.col("category") == category)).groupBy("url")
    return (rows.pivot("name", names) if names else rows.pivot("name")).agg(F.first("value"))


def relational(claims: DataFrame, links: DataFrame, longest: int = 500) -> dict[str, DataFrame]:
    """Tables site, source, page, attribute, pid for a database; texts are cut, links count for known pages alone."""
    short = lambda c: F.substring(F.col(c).cast("string"), 1, longest).alias(c)
    pages = claims.select("site", "category", "url").distinct()
    known = links.join(pages, ["site", "category", "url"])
    return {
        "site": claims.select(short("site")).distinct(),
        "source": claims.select(short("site"), short("category")).distinct(),
        "page": pages.select(short("site"), short("category"), short("url")),
        "attribute": claims.select(short("site"), short("category"), short("url"), short("name"), short("value")),
        "pid": known.select(short("pid"), short("site"), short("category"), short("url")),
        "missing": links.join(pages, ["site", "category", "url"], "left_anti"),
    }


def jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    for name, table in tables.items():
        table.write.mode(mode).option("truncate", True).jdbc(url, name, properties=properties or {})


def triples(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Tab separated (entity, attribute, value) lines for link prediction."""
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\s+", "_")
    return claims.join(links, ["site", "category", "url"]).select(F.concat_ws("\t", clean("pid"), clean("name"), clean("value")).alias("value")).distinct()


def snapshot(table: DataFrame, path: str) -> DataFrame:
    """table as it was written to path: by an earlier run if there is one, else now."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
