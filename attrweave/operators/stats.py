"""Statistics of sources, attributes, linkage and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.functions.numbers import safe_divide
from attrweave.operators.claims import SA, head_tail
from attrweave.operators.shared import cut, width


def source_schema(claims: DataFrame) -> DataFrame:
    """Of each source: pages, schema size, median attributes of a page, average use of its attributes, how many attributes
    are on 10, 55, 85 and 95 % of the pages, and the pages of the most used."""
    # One exchange, by page; pages of the same attributes are counted, and all the rest comes from these counts.
    rows = claims.select(*SA, "url").repartition(width(claims.sparkSession, claims), "url").distinct()
    kinds = rows.groupBy("site", "category", "url").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("names")).groupBy("site", "category", "names").agg(F.count("*").alias("n"))
    kinds = cut(kinds.withColumn("attrs", F.size(F.filter("names", lambda x: x["name"].isNotNull()))))
    per = kinds.groupBy("site", "category").agg(F.sum("n").alias("pages"), F.percentile("attrs", 0.5, F.col("n")).alias("median_attrs"))
    used = kinds.select("site", "category", "n", F.inline("names")).groupBy(*SA).agg(F.sum("n").alias("n")).join(per, ["site", "category"])
    share = F.col("n") / F.col("pages")
    out = used.groupBy("site", "category").agg(
        F.first("pages").alias("pages"),
        F.count("*").alias("schema_size"),
        F.first("median_attrs").alias("median_attrs"),
        F.round(F.avg(share), 6).alias("avg_use"),
        *[F.count(F.when(share >= t / 100, 1)).alias(f"over_{t}") for t in (10, 55, 85, 95)],
        F.max("n").alias("top_pages"),
    )
    return out


def source_attributes(claims: DataFrame, k: int = 3) -> DataFrame:
    """The k most and least used attributes of each source, joined by |."""
    used = claims.select(*SA, "url").distinct().groupBy(*SA).agg(F.count("*").alias("n"))
    w = Window.partitionBy("site", "category")
    ranked = used.withColumn("a", F.row_number().over(w.orderBy(F.col("n").desc(), "name"))).withColumn("b", F.row_number().over(w.orderBy("n", "name")))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= k, F.struct(c, "name")))), lambda x: x["name"]), "|")
    return ranked.groupBy("site", "category").agg(text("a").alias("top"), text("b").alias("bottom"))


def general(claims: DataFrame, linkage: DataFrame) -> DataFrame:
    """Of each category, and as ALL their sums: sources, pages, attributes, claims, different values, linked pages, entities."""
    def different(df: DataFrame, *of: str, name: str) -> DataFrame:
        """Counted each by itself: together every row would go through the exchange once for each count."""
        rows = df.select("category", *of).dropna(subset=list(of))
        if "url" in of:  # hardly any are alike, where popular values are
            rows = rows.repartition(width(df.sparkSession, df), "category", "url")
        return rows.distinct().groupBy("category").agg(F.count("*").alias(name))

    attributes = claims.groupBy("category", "site", "name").agg(F.count("*").alias("n"))
    rows = attributes.groupBy("category").agg(F.countDistinct("site").alias("sources"), F.countDistinct("site", "name").alias("attributes"), F.sum("n").alias("instances"))
    known = linkage.filter("category is not null")
    for more in (different(claims, "site", "url", name="pages"), different(claims, "value", name="distinct_values"), different(known, "site", "url", name="linked_pages"), different(known, "pid", name="entities")):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.groupBy("category").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sources", "pages", "attributes", "instances", "distinct_values", "linked_pages", "entities")]).filter("instances > 0")
    return rows.unionByName(rows.agg(F.lit("ALL").alias("category"), *[F.sum(x).alias(x) for x in rows.columns if x != "category"]))


def attribute_analysis(claims: DataFrame, k: int = 4) -> DataFrame:
    """Of each attribute its size, part of the source's pages, different values and k most frequent values, joined by |."""
    pages = claims.groupBy("site", "category").agg(F.countDistinct("url").alias("pages"))
    seen = claims.groupBy(*SA, "value").agg(F.count("*").alias("n"))
    ranked = seen.withColumn("k", F.row_number().over(Window.partitionBy(*SA).orderBy(F.col("n").desc(), "value")))
    out = ranked.groupBy(*SA).agg(F.sum("n").alias("size"), F.count("*").alias("domain"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= k, F.struct("k", "value")))), lambda x: x["value"]), "|").alias("top"))
    return out.join(pages, ["site", "category"]).withColumn("ratio", F.round(F.col("size") / F.col("pages"), 6)).drop("pages")


def similar_inside(claims: DataFrame, k: int = 4) -> DataFrame:
    """Attribute pairs of a source that share one of their k most frequent values and are never on the same page."""
    seen = claims.groupBy(*SA, "value").agg(F.count("*").alias("n"))
    top = seen.withColumn("k", F.row_number().over(Window.partitionBy(*SA).orderBy(F.col("n").desc(), "value"))).filter(F.col("k") <= k)
    a, b = top.select("site", "category", "value", F.col("name").alias("name1")), top.select("site", "category", "value", F.col("name").alias("name2"))
    alike = a.join(b, ["site", "category", "value"]).filter("name1 < name2").select("site", "category", "name1", "name2").distinct()
    p = claims.select(*SA, "url").distinct()
    one, two = p.withColumnRenamed("name", "name1"), p.withColumnRenamed("name", "name2")
    together = alike.join(one, ["site", "category", "name1"]).join(two, ["site", "category", "name2", "url"]).select("site", "category", "name1", "name2").distinct()
    return alike.join(together, ["site", "category", "name1", "name2"], "left_anti")


def homogeneity(claims: DataFrame) -> DataFrame:
    """Of each source the mean Jaccard of the different attribute sets of its pages, pair by pair."""
    sets = claims.groupBy("site", "category", "url").agg(F.array_sort(F.collect_set("name")).alias("names")).select("site", "category", "names").distinct()
    a, b = sets.withColumnRenamed("names", "x"), sets.withColumnRenamed("names", "y")
    met = a.join(b, ["site", "category"]).filter("x < y").select("site", "category", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("j"))
    return sets.groupBy("site", "category").agg(F.count("*").alias("schemas")).join(met.groupBy("site", "category").agg(F.avg("j").alias("j")), ["site", "category"], "left").select("site", "category", "schemas", F.round(F.coalesce("j", F.lit(1.0)), 6).alias("homogeneity"))


def copies(claims: DataFrame, most_pages: int = 8, least_shared: int = 3, ratio: float = 0.5) -> DataFrame:
    """Page pairs that share `least_shared` claims which few pages have, and more than `ratio` of the lesser page's.

    Only claims on fewer than `most_pages` pages count, for the ratio too; page_copies() compares whole pages.
    """
    rows = claims.select("category", "site", "url", "name", "value").distinct()
    rare = rows.groupBy("category", "name", "value").agg(F.count("*").alias("n")).filter((F.col("n") < most_pages) & (F.col("n") > 1)).select("category", "name", "value")
    held = rows.join(rare, ["category", "name", "value"])
    node = F.concat_ws("//", "site", "url")
    a, b = held.select("category", "name", "value", node.alias("p1")), held.select("category", "name", "value", node.alias("p2"))
    shared = a.join(b, ["category", "name", "value"]).filter("p1 < p2").groupBy("category", "p1", "p2").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)
    size = rows.groupBy("category", node.alias("p")).agg(F.count("*").alias("n"))
    met = shared.join(size.withColumnsRenamed({"p": "p1", "n": "n1"}), ["category", "p1"]).join(size.withColumnsRenamed({"p": "p2", "n": "n2"}), ["category", "p2"])
    return met.withColumn("ratio", F.round(F.col("shared") / F.least("n1", "n2"), 6)).filter(F.col("ratio") > ratio).select("category", "p1", "p2", "shared", "ratio")


def page_copies(claims: DataFrame, least_shared: int = 3, ratio: float = 0.9) -> DataFrame:
    """Page pairs of a category with `least_shared` claims in common, which are more than `ratio` of the larger page's.

    All claims but page titles count, with folded values, however many pages have them. Pages of equal claims are one set.
    Different sets meet by their rarest claims: of n claims as many as leave too few for a pair when none of them is shared.
    """
    claim = F.concat_ws("\u0001", "name", T.fold(F.col("value")))
    pages = claims.filter("name <> '<page title>'").groupBy("category", "site", "url").agg(F.array_sort(F.collect_set(claim)).alias("claims")).withColumn("set", F.sha2(F.array_join("claims", "\u0002"), 256))
    sets = pages.select("category", "set", "claims").distinct().withColumn("n", F.size("claims")).filter(F.col("n") >= least_shared)
    needed = F.greatest(F.lit(least_shared), F.floor(F.col("n") * ratio - 1e-9) + 1)
    # A set that isn't larger than the ratio of one more claim has no partner but its equals.
    held = sets.filter(F.col("n") / (F.col("n") + 1) > ratio).select("category", "set", "n", needed.alias("needed"), F.explode("claims").alias("claim"))
    often = held.groupBy("category", "claim").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("category", "set").orderBy("often", "claim"))
    first = held.join(often, ["category", "claim"]).withColumn("k", rank).filter("k <= n - needed + 1").select("category", "claim", "set", "n")
    a, b = first.withColumnsRenamed({"set": "s1", "n": "n1"}), first.withColumnsRenamed({"set": "s2", "n": "n2"})
    met = a.join(b, ["category", "claim"]).filter((F.col("s1") < F.col("s2")) & (F.least("n1", "n2") / F.greatest("n1", "n2") > ratio)).select("category", "s1", "s2").distinct()
    one, two = sets.select("category", F.col("set").alias("s1"), F.col("claims").alias("c1")), sets.select("category", F.col("set").alias("s2"), F.col("claims").alias("c2"))
    both = met.join(one, ["category", "s1"]).join(two, ["category", "s2"]).withColumn("shared", F.size(F.array_intersect("c1", "c2"))).withColumn("ratio", F.col("shared") / F.greatest(F.size("c1"), F.size("c2")))
    alike = both.select("category", "s1", "s2", "shared", "ratio").unionByName(sets.select("category", F.col("set").alias("s1"), F.col("set").alias("s2"), F.col("n").alias("shared"), F.lit(1.0).alias("ratio")))
    alike = alike.filter((F.col("shared") >= least_shared) & (F.col("ratio") > ratio))
    p, q = pages.select("category", F.col("set").alias("s1"), F.struct("site", "url").alias("p")), pages.select("category", F.col("set").alias("s2"), F.struct("site", "url").alias("q"))
    pairs = alike.join(p, ["category", "s1"]).join(q, ["category", "s2"]).filter("s1 <> s2 or p < q")
    x, y = F.least("p", "q"), F.greatest("p", "q")
    return pairs.select("category", x["site"].alias("site1"), x["url"].alias("url1"), y["site"].alias("site2"), y["url"].alias("url2"), "shared", F.round("ratio", 6).alias("ratio"))


def potential_linkages(claims: DataFrame, most_pages: int = 100, least: float = 0.1) -> DataFrame:
    """Page pairs of different sources whose shared values sum to more than `least`, each worth 1 / pages."""
    rows = claims.select("category", "site", "url", "value").distinct()
    worth = rows.groupBy("category", "value").agg(F.count("*").alias("n")).filter((F.col("n") <= most_pages) & (F.col("n") > 1))
    held = rows.join(worth, ["category", "value"])
    a, b = held.select("category", "value", "n", F.col("site").alias("site1"), F.col("url").alias("url1")), held.select("category", "value", F.col("site").alias("site2"), F.col("url").alias("url2"))
    return a.join(b, ["category", "value"]).filter("site1 < site2").groupBy("category", "site1", "url1", "site2", "url2").agg(F.round(F.sum(1 / F.col("n")), 6).alias("score")).filter(F.col("score") > least)


def linkage_stats(linkage: DataFrame) -> DataFrame:
    """Pages, pages of more than one entity, entities, linked page pairs of one entity, entities with two pages of a source."""
    n = width(linkage.sparkSession, linkage)
    multi = linkage.select("category", "site", "url", "pid").repartition(n, "url").groupBy("category", "site", "url").agg(F.countDistinct("pid").alias("p")).groupBy("category").agg(F.count("*").alias("pages"), F.count(F.when(F.col("p") > 1, 1)).alias("multi_pages"))
    size = linkage.select("category", "pid", "site", "url").distinct().groupBy("category", "pid", "site").agg(F.count("*").alias("n")).groupBy("category", "pid").agg(F.sum("n").alias("n"), F.count("site").alias("s"))
    per = size.groupBy("category").agg(F.count("*").alias("entities"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.count(F.when(F.col("n") > F.col("s"), 1)).alias("conflicting"))
    return multi.join(per, "category")


def size_buckets(linkage: DataFrame, step: float = 0.5) -> DataFrame:
    """Entities and pages by bucket of entity size: bucket k holds sizes from 10 ** (k * step) on."""
    size = linkage.groupBy("category", "pid").agg(F.count("*").alias("n"))
    return size.groupBy("category", F.floor(F.log10("n") / step + 1e-9).cast("int").alias("bucket")).agg(F.count("*").alias("entities"), F.sum("n").alias("pages"))


def entropy(table: DataFrame, column: str, step: float, by: list[str] = ()) -> DataFrame:
    """Entropy, in nats, of a column's values that aren't negative, in buckets of a fixed width."""
    cells = table.groupBy(*by, F.floor(F.col(column) / step).alias("__b")).agg(F.count("*").alias("n"))
    whole = cells.groupBy(*by).agg(F.sum("n").alias("t")) if by else cells.agg(F.sum("n").alias("t"))
    met = cells.join(whole, list(by)) if by else cells.crossJoin(F.broadcast(whole))
    p = F.col("n") / F.col("t")
    return met.groupBy(*by).agg(F.round(F.sum(-p * F.log(p)), 6).alias("entropy"), F.count("*").alias("buckets"))


def group_sizes(table: DataFrame, size: str, by: list[str] = ()) -> DataFrame:
    """Number, mean and median of sizes, over all, and of their head and tail."""
    rows = head_tail(table, size, list(by))
    head, tail = F.when(F.col("part") == "HEAD", F.col(size)), F.when(F.col("part") == "TAIL", F.col(size))
    return rows.groupBy(*by).agg(*[x for n, c in (("all", F.col(size)), ("head", head), ("tail", tail)) for x in (F.count(c).alias(f"{n}_n"), F.round(F.avg(c), 6).alias(f"{n}_mean"), F.percentile(c, 0.5).alias(f"{n}_median"))])


def clustering_stats(clustered: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: attributes, part in a cluster, average cluster size, part of the claims in clustered attributes.

    clustered: cid, site, category, name; sizes: site, category, name, size.
    """
    met = sizes.join(clustered, SA, "left")
    return met.agg(
        F.count("*").alias("attributes"),
        F.round(F.count("cid") / F.count("*"), 6).alias("clustered_part"),
        F.round(safe_divide(F.count("cid").cast("double"), F.countDistinct("cid").cast("double")), 6).alias("avg_size"),
        F.round(F.sum(F.when(F.col("cid").isNotNull(), F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("claims_part"),
    )


def linked_pages(claims: DataFrame, linkage: DataFrame) -> DataFrame:
    """Linked pages of each attribute; a page of several entities counts for each."""
    return claims.join(linkage, ["site", "category", "url"]).groupBy(*SA).agg(F.count("*").alias("linked_pages"))


def copy_ratios(copied: DataFrame, claims: DataFrame) -> DataFrame:
    """Of each source the part of its pages that are copied from or to another source, or inside it (INTERNAL).

    copied: category, site1, url1, site2, url2 as from page_copies().
    """
    ways = F.array(*[F.struct(F.col(f"site{a}").alias("site"), F.col(f"url{a}").alias("url"), F.col(f"site{b}").alias("other")) for a, b in ((1, 2), (2, 1))])
    rows = copied.select("category", F.inline(ways)).withColumn("other", F.when(F.col("site") == F.col("other"), "INTERNAL").otherwise(F.col("other")))
    pages = claims.groupBy("category", "site").agg(F.countDistinct("url").alias("pages"))
    counted = rows.groupBy("category", "site", "other").agg(F.countDistinct("url").alias("copied"))
    return counted.join(pages, ["category", "site"]).select("category", "site", "other", "copied", F.round(F.col("copied") / F.col("pages"), 6).alias("ratio"))


def joined_entities(linkage: DataFrame, by: str = "|") -> DataFrame:
    """adjacency() with the entities as one text, which is put together of the texts of ranges of them."""
    n = width(linkage.sparkSession, linkage)
    rows = linkage.select("site", "category", "pid").distinct()
    ranges = cut(rows.repartitionByRange(n, "site", "category", "pid").withColumn("p", F.spark_partition_id()))
    texts = ranges.groupBy("site", "category", "p").agg(F.array_join(F.array_sort(F.collect_list("pid")), by).alias("t"), F.count("pid").alias("n"))
    some = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("p", "t"))))
    return texts.groupBy("site", "category").agg(F.array_join(F.transform(some, lambda x: x["t"]), by).alias("pids"))


def adjacency(linkage: DataFrame) -> DataFrame:
    """The entities of each source, sorted."""
    return linkage.groupBy("site", "category").agg(F.array_sort(F.collect_set("pid")).alias("pids"))
