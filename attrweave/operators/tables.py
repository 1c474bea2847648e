"""Side-by-side tables, merges of tables and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators.shared import alike, beside, cut, product, width


def alignment(claims: DataFrame, linkage: DataFrame, nodes: list[tuple[str, str]], missing: str = "NULL") -> DataFrame:
    """A row for each entity, a column `site/name` for each of the attributes (site, name), with their values joined by |."""
    names = [f"{s}/{n}" for s, n in nodes]
    rows = claims.withColumn("__c", F.concat_ws("/", "site", "name")).filter(F.col("__c").isin(names)).join(linkage, ["site", "category", "url"])
    wide = rows.groupBy("pid").pivot("__c", names).agg(F.array_join(F.array_sort(F.collect_set(F.col("value").cast("string"))), "|"))
    return linkage.select("pid").distinct().join(wide, "pid", "left").select("pid", *[F.coalesce(F.nullif(F.col(f"`{n}`"), F.lit("")), F.lit(missing)).alias(n) for n in names])


def value_table(claims: DataFrame, nodes: list[tuple[str, str]]) -> DataFrame:
    """A row for each value, a column of counts for each attribute; the row of value NULL has the pages of the source without it."""
    names = [f"{s}/{n}" for s, n in nodes]
    rows = claims.withColumn("__c", F.concat_ws("/", "site", "name"))
    wide = rows.filter(F.col("__c").isin(names)).groupBy(F.col("value").cast("string").alias("value")).pivot("__c", names).agg(F.count(F.lit(1)))
    pages = rows.groupBy("site").agg(F.countDistinct("url").alias("pages"))
    have = rows.filter(F.col("__c").isin(names)).groupBy("site", "__c").agg(F.countDistinct("url").alias("n")).join(pages, "site")
    none = have.groupBy().pivot("__c", names).agg(F.first(F.col("pages") - F.col("n"))).select(F.lit("NULL").alias("value"), *[F.col(f"`{n}`") for n in names])
    return wide.unionByName(none).select("value", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def apart_by_name(clustered: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of one name without a common cluster, with their common and own most frequent values.

    clustered: cid, node; nodes: node, name, top (array of values).
    """
    cids = clustered.groupBy("node").agg(F.collect_set("cid").alias("cids"))
    rows = nodes.join(cids, "node")
    # Nodes of a name with equal values and clusters are one class: a pair of classes is compared once and written out as pairs.
    held = cut(alike(rows, ["name", "top", "cids"], "node"))
    first = held.filter("node = r").distinct()
    a, b = (first.select("name", F.col("r").alias(f"r{k}"), F.col("top").alias(f"t{k}"), F.col("cids").alias(f"c{k}")) for k in (1, 2))
    n = width(nodes.sparkSession)
    met = a.repartition(n, "name").join(b.repartition(n, "name"), "name").filter(~F.arrays_overlap("c1", "c2"))
    pairs = met.select("name", "r1", "r2", F.array_intersect("t1", "t2").alias("common"), F.array_except("t1", "t2").alias("only1"), F.array_except("t2", "t1").alias("only2"))
    found = product(pairs, held.select("name", "r", "node"), ["name"], "node").filter("node1 < node2")
    return found.select("name", F.col("node1").alias("n1"), F.col("node2").alias("n2"), "common", "only1", "only2")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with columns of one name coalesced; of rows that agree in the key the one with the fewest nulls stays."""
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    a, b = left.alias("a"), right.alias("b")
    pick = lambda c: F.coalesce(*[F.nullif(F.col(f"{s}.`{c}`").cast("string"), F.lit("")) for s, t in (("a", left), ("b", right)) if c in t.columns]).alias(c)
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c) for c in names])
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in names), F.lit(0))
    w = Window.partitionBy(key).orderBy(nulls, *[F.col(f"`{c}`") for c in names])
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def both_linkages(category: DataFrame, community: DataFrame) -> DataFrame:
    """Rows (pid, site, category, url) whose page has the same entity in both linkages."""
    return category.join(community.select("pid", "url").distinct(), ["pid", "url"], "left_semi")


def truth_by_instance(truth: DataFrame, claims: DataFrame) -> DataFrame:
    """A ground truth by schema (site, name, target) as one by instance."""
    rows = beside(claims, truth, ["site", "name"], ["url"]).select("site", "url", "name", "target")
    return rows.repartition(width(claims.sparkSession, claims), "url").distinct()


def model_linkage(titles: DataFrame, **patterns: str) -> DataFrame:
    """Entities by model codes: rows (pid, site, category, url) of codes in the titles of two pages at least."""
    rows = titles.select("site", "category", "url", F.explode(T.model_codes(F.lower("title"), **patterns)).alias("pid")).distinct()
    many = rows.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(many, "pid", "left_semi").select("pid", "site", "category", "url")


def targets_that_meet(truth: DataFrame) -> DataFrame:
    """Pairs of target sets, as sorted arrays, that share a target; truth: node, target."""
    sets = truth.groupBy("node").agg(F.array_sort(F.collect_set("target")).alias("targets")).select("targets").distinct()
    each = sets.select("targets", F.explode("targets").alias("t"))
    a, b = each.select("t", F.col("targets").alias("a")), each.select("t", F.col("targets").alias("b"))
    return a.join(b, "t").filter("a < b").select("a", "b").distinct()


def ontology(found: DataFrame, truth: DataFrame, most: int = 3) -> DataFrame:
    """By rank up to `most`: true and false positives, missing ones and targets named twice; found: name, target, place; truth:
    name, target."""
    hits = found.filter(F.col("place") <= most).join(truth.withColumn("ok", F.lit(1)), ["name", "target"], "left")
    w = Window.partitionBy("target").orderBy("place", "name")
    marked = hits.withColumn("again", (F.row_number().over(w) > 1).cast("int"))
    per = marked.groupBy("place").agg(F.sum(F.coalesce("ok", F.lit(0))).alias("tp"), F.sum(1 - F.coalesce("ok", F.lit(0))).alias("fp"), F.sum("again").alias("duplicated"))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row for each rank
    whole = truth.count()
    return per.select("place", *[F.sum(c).over(upto).alias(c) for c in ("tp", "fp", "duplicated")]).withColumn("fn", F.lit(whole) - F.col("tp"))


def link_triples(claims: DataFrame, linkage: DataFrame) -> DataFrame:
    """Different triples (pid, name, value) of linked pages, with how many values the entity has for the name: one is
    inductable, more are ambiguous."""
    return triples(claims.join(linkage, ["site", "category", "url"]))


def triples(linked: DataFrame) -> DataFrame:
    """link_triples() of claims that have their pid."""
    rows = linked.select("pid", "name", F.col("value").cast("string").alias("value")).repartition(width(linked.sparkSession, linked), "pid", "name").distinct()
    return rows.withColumn("values", F.count("*").over(Window.partitionBy("pid", "name")))


def link_prediction(triples: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions (pid, name, value) counted as known, inductable (the entity has no value for the name, another page of it
    could) or ambiguous."""
    # Both come to the name of an entity by one exchange, and are counted there.
    rows = predicted.select("pid", "name", F.col("value").cast("string").alias("value"), F.lit(1).alias("guess")).unionByName(triples.select("pid", "name", "value", F.lit(0).alias("guess")))
    rows = rows.repartition(width(rows.sparkSession, rows), "pid", "name").groupBy("pid", "name", "value").agg(F.sum("guess").alias("guesses"), F.count(F.when(F.col("guess") == 0, 1)).alias("known"))
    whole = F.col("pid").isNotNull() & F.col("name").isNotNull()
    seen = rows.withColumn("values", F.when(whole, F.sum("known").over(Window.partitionBy("pid", "name"))).otherwise(0)).filter("guesses > 0")
    kind = F.when((F.col("known") > 0) & whole & F.col("value").isNotNull(), "known").when(F.col("values") == 0, "inductable").otherwise("ambiguous")
    return seen.groupBy(kind.alias("kind")).agg(F.sum("guesses").alias("n"))


def golden_pairs(domain: DataFrame, sources: list[str], least: float = 0.2) -> DataFrame:
    """Attribute pairs of the sources whose domains have a bag Jaccard of at least `least`, to be judged by hand."""
    from attrweave.operators.matching import PAIR, _sides, domain_jaccard

    rows = domain.filter(F.col("site").isin(sources))
    pairs = _sides(rows, ["category", "value"]).select(*PAIR).distinct()
    return domain_jaccard(rows, pairs).filter(F.col("similarity") >= least)


def truth_row(*parts: str | Column) -> Column:
    """Keys like site//page//name."""
    return F.concat_ws("//", *parts)


def synthetic_name(name: Column) -> Column:
    """source, page or attribute number and kind of a synthetic name such as src3_att12_h."""
    return F.struct(F.regexp_extract(name, r"src([0-9]+)", 1).alias("source"), F.regexp_extract(name, r"(?:att|page)([0-9]+)", 1).alias("number"), F.regexp_extract(name, r"_([a-z])$", 1).alias("kind"))
