"""Record linkage: which pages describe the same entity, by rare values and aligned attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions.numbers import bayes, safe_log
from attrweave.operators.shared import paired

PAGE_PAIR = ["category", "site1", "url1", "site2", "url2"]


def rare_values(claims: DataFrame, common: DataFrame, cover: int = 4, volume: float = 2.0, most: int = 30) -> DataFrame:
    """Rare values of each source, the rarest first, up to and with the one at which a rule stops: all pages are covered and
    it is on more than min(pages - 1, cover) of them; pages sum to more than volume * pages; it is on more than `most`.

    common: values (category, value) left out, as are values of a single source.
    """
    pages = claims.select("site", "category", "url").distinct().groupBy("site", "category").agg(F.count("*").alias("size"))
    spread = claims.groupBy("category", "value").agg(F.countDistinct("site").alias("s")).filter("s > 1").select("category", "value")
    rows = claims.select("site", "category", "url", "value").distinct().join(spread, ["category", "value"], "left_semi").join(common.select("category", "value"), ["category", "value"], "left_anti")
    count = rows.groupBy("site", "category", "value").agg(F.count("*").alias("n")).join(pages, ["site", "category"])
    order = Window.partitionBy("site", "category").orderBy("n", "value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = count.withColumn("place", F.row_number().over(Window.partitionBy("site", "category").orderBy("n", "value"))).withColumn("volume", F.sum("n").over(order))
    # A page is covered at the place of its first value; covered pages by place are a running count.
    first = rows.join(ranked.select("site", "category", "value", "place"), ["site", "category", "value"]).groupBy("site", "category", "url").agg(F.min("place").alias("place"))
    newly = first.groupBy("site", "category", "place").agg(F.count("*").alias("fresh"))
    covered = ranked.join(newly, ["site", "category", "place"], "left").withColumn("covered", F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy("site", "category").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    stop = ((F.col("covered") >= F.col("size")) & (F.col("n") > F.least(F.col("size") - 1, F.lit(cover)))) | (F.col("volume") > volume * F.col("size")) | (F.col("n") > most)
    ends = covered.withColumn("end", F.min(F.when(stop, F.col("place"))).over(Window.partitionBy("site", "category")))
    return ends.filter("end is null or place <= end").select("site", "category", "value", "n", "place")


def blocks(claims: DataFrame, rare: DataFrame, linkage: DataFrame | None = None, existing: int = 150) -> DataFrame:
    """Rows (category, site, url, block, score) to be met: a block for each value that is rare in a source, of a score of
    round(1000 / pages), and one of each linked entity."""
    values = rare.groupBy("category", "value").agg(F.sum("n").alias("n"))
    met = claims.select("category", "site", "url", "value").distinct().join(values, ["category", "value"])
    rows = met.select("category", "site", "url", F.concat(F.lit("v"), F.col("value").cast("string")).alias("block"), F.round(1000 / F.col("n")).cast("int").alias("score"))
    if linkage is not None:
        rows = rows.unionByName(linkage.select("category", "site", "url", F.concat(F.lit("p"), F.col("pid")).alias("block"), F.lit(existing).alias("score")))
    return rows


def page_candidates(rows: DataFrame, least: int = 150) -> DataFrame:
    return paired(rows, "site", "url", "block", "score", least, ["category"])


def page_probabilities(pairs: DataFrame, claims: DataFrame, clustered: DataFrame, error_rate: float = 0.1, prior: float = 0.1, alike: Column | None = None) -> DataFrame:
    """Columns PAGE_PAIR, p of page pairs that have an equal value of aligned attributes; clustered: cid, site, category, name."""
    rows = claims.join(clustered, ["site", "category", "name"])
    domain = rows.groupBy("category", "cid", "site", "name", "value").agg(F.count("*").alias("d"))
    size = claims.groupBy("category", "site", "name").agg(F.count("*").alias("n"))
    keep = rows.select("category", "cid", "site", "url", "name", "value")
    one = keep.withColumnsRenamed({"site": "site1", "url": "url1", "name": "name1", "value": "value1"})
    two = keep.withColumnsRenamed({"site": "site2", "url": "url2", "name": "name2", "value": "value2"})
    met = pairs.select(*PAGE_PAIR).join(one, ["category", "site1", "url1"]).join(two, ["category", "cid", "site2", "url2"])
    for k, other in ((1, 2), (2, 1)):
        mine = domain.drop("cid").withColumnsRenamed({"site": f"site{k}", "name": f"name{k}", "value": f"value{k}", "d": f"d{k}{k}"})
        cross = domain.drop("cid").withColumnsRenamed({"site": f"site{other}", "name": f"name{other}", "value": f"value{k}", "d": f"d{other}{k}"})
        met = met.join(mine, ["category", f"site{k}", f"name{k}", f"value{k}"]).join(cross, ["category", f"site{other}", f"name{other}", f"value{k}"], "left")
        met = met.join(size.withColumnsRenamed({"site": f"site{k}", "name": f"name{k}", "n": f"s{k}"}), ["category", f"site{k}", f"name{k}"])
    whole = F.col("s1") + F.col("s2")
    f1, f2 = (F.col("d11") + F.coalesce("d21", F.lit(0))) / whole, (F.coalesce("d12", F.lit(0)) + F.col("d22")) / whole
    e = error_rate * (2 - error_rate)
    equal = (F.col("value1") == F.col("value2")) if alike is None else (F.col("value1") == F.col("value2")) | alike
    positive = F.when(equal, f1 * (1 - e * (1 - f1))).otherwise(e * f1 * f2)
    odds = met.groupBy(*PAGE_PAIR).agg(F.sum(safe_log(positive) - safe_log(f1 * f2)).alias("odds"), F.max(equal.cast("int")).alias("any"))
    return odds.filter("any = 1").select(*PAGE_PAIR, bayes(F.lit(prior), F.col("odds")).alias("p"))


def behave(candidates: DataFrame, linkage: DataFrame, mode: str = "BOTH") -> DataFrame:
    """ADD: candidates that aren't linked yet; DELETE: only those that are; BOTH: all."""
    if mode == "BOTH":
        return candidates
    rows = linkage.select("category", "pid", "site", "url").distinct()
    a, b = rows.withColumnsRenamed({"site": "site1", "url": "url1"}), rows.withColumnsRenamed({"site": "site2", "url": "url2"})
    held = a.join(b, ["category", "pid"]).filter("site1 < site2").select(*PAGE_PAIR).distinct()
    return candidates.join(held, PAGE_PAIR, {"ADD": "left_anti", "DELETE": "left_semi"}[mode])
