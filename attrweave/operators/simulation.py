"""Perturbed inputs: fewer sources, less linkage, wrong linkage. Every draw has a seed and is a hash, so it can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def keep_sources(claims: DataFrame, linkage: DataFrame, count: int, mode: str = "RANDOM", mandatory: list[str] = (), seed: int = 1) -> DataFrame:
    """Claims of `count` sources: the mandatory first, then those of MORE or LESS linkage, or RANDOM ones; NONE keeps all."""
    if mode == "NONE":
        return claims
    sources = claims.select("site").distinct().join(linkage.groupBy("site").agg(F.count("*").alias("links")), "site", "left").na.fill(0, ["links"])
    order = {"MORE": [F.col("links").desc()], "LESS": [F.col("links")], "RANDOM": [draw(seed, "site")]}[mode]
    first = (~F.col("site").isin(list(mandatory))).cast("int") if mandatory else F.lit(1)
    return claims.join(sources.orderBy(first, *order, "site").limit(count), "site", "left_semi")


def remove_linkage(linkage: DataFrame, ratio: float, mode: str = "RANDOM", seed: int = 1) -> DataFrame:
    """Linkage without the entities, in order of mode (RANDOM, KEEP_SMALL: the largest go first, KEEP_BIG: the smallest),
    that are removed until at least 1 - ratio of the linked pages have gone."""
    size = linkage.groupBy("pid").agg(F.count("*").alias("n"))
    order = {"RANDOM": [draw(seed, "pid")], "KEEP_SMALL": [F.col("n").desc()], "KEEP_BIG": [F.col("n")]}[mode]
    # One row an entity. The sums by order value come first, so that the running sum sees few rows where sizes repeat.
    w = Window.orderBy(*order, "pid").rowsBetween(Window.unboundedPreceding, -1)
    before = size.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("whole", F.sum("n").over(Window.partitionBy()))
    return linkage.join(before.filter(F.col("before") >= (1 - ratio) * F.col("whole")).select("pid"), "pid", "left_semi")


def add_errors(linkage: DataFrame, pages: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """Linkage with wrong rows, up to ratio times as many as it has: a page each, drawn with an entity it isn't of."""
    pids = linkage.select("pid").distinct()
    count = pids.count()
    if not count:
        return linkage
    wanted = int(ratio * linkage.count())
    numbered = pids.select("pid", F.pmod(draw(seed, "pid"), F.lit(max(count, 1))).alias("slot")).groupBy("slot").agg(F.min("pid").alias("pid"))
    drawn = pages.select("site", "category", "url").distinct().withColumn("slot", F.pmod(draw(seed + 1, "site", "category", "url"), F.lit(max(count, 1))))
    wrong = drawn.join(numbered, "slot").select("pid", "site", "category", "url").join(linkage, ["pid", "site", "category", "url"], "left_anti")
    return linkage.select("pid", "site", "category", "url").unionByName(wrong.orderBy(draw(seed + 2, "pid", "url"), "pid", "url").limit(wanted))


def stratified(table: DataFrame, strata: list[Column], reduction: float, key: str, seed: int = 1) -> DataFrame:
    """A sample of each combination of strata: its rows over `reduction`, one at least."""
    names = [f"__s{k}" for k in range(len(strata))]
    rows = table.withColumns(dict(zip(names, strata)))
    w = Window.partitionBy(*names)
    ranked = rows.withColumn("__k", F.row_number().over(w.orderBy(draw(seed, key), key))).withColumn("__n", F.count("*").over(w))
    return ranked.filter(F.col("__k") <= F.greatest(F.lit(1), F.round(F.col("__n") / reduction))).drop(*names, "__k", "__n")


def coverage_order(rows: DataFrame, source: str, item: str, steps: int | None = None) -> list[tuple[str, int]]:
    """Sources by greedy coverage: each next one has the most items not covered yet (ties by name), with their number.

    The items stay distributed; a step collects one row. It ends when everything is covered, or after `steps`.
    """
    from attrweave.operators.shared import cut

    left, out = cut(rows.select(F.col(source).alias("s"), F.col(item).alias("i")).distinct()), []
    while steps is None or len(out) < steps:
        best = left.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "s").first()
        if best is None:
            break
        out.append((best["s"], best["n"]))
        left = cut(left.join(left.filter(F.col("s") == best["s"]).select("i"), "i", "left_anti"))
    return out
