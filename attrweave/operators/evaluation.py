"""How well a clustering agrees with an expected one, by pairs.

Pairs are counted, not listed, wherever a count suffices: a group of n gives n (n - 1) / 2 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions.numbers import f_measure, pairs_of, significant
from attrweave.operators.shared import cut, width


def metrics(counts: DataFrame, tp: str = "tp", computed: str = "computed", expected: str = "expected", digits: int = 3) -> DataFrame:
    """counts with p, r, f: of so many significant digits; -1 where nothing was computed or expected."""
    p = F.when(F.col(computed) == 0, -1.0).otherwise(F.col(tp) / F.col(computed))
    r = F.when(F.col(expected) == 0, -1.0).otherwise(F.col(tp) / F.col(expected))
    f = f_measure(p, r)
    show = lambda c: F.when(c < 0, c).otherwise(significant(c, digits))
    return counts.select("*", show(p).alias("p"), show(r).alias("r"), show(f).alias("f"))


def by_cells(table: DataFrame, node: str, computed: str, expected: str, by: list[str] = ()) -> DataFrame:
    """Pair metrics of nodes that have one computed and one expected cluster each."""
    rows = table.select(*by, F.col(computed).alias("__c"), F.col(expected).alias("__e"), node)
    cells = rows.groupBy(*by, "__c", "__e").agg(F.count("*").alias("n"))
    part = lambda k: cells.groupBy(*by, k).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).cast("long").alias({"__c": "computed", "__e": "expected"}[k]))
    tp = cells.groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).cast("long").alias("tp"))
    if by:
        return metrics(tp.join(part("__c"), list(by)).join(part("__e"), list(by)))
    return metrics(tp.crossJoin(part("__c")).crossJoin(part("__e")))


def pairs(membership: DataFrame, node: str, group: str, keep: list[str] = (), once: bool = True) -> DataFrame:
    """Unordered pairs of nodes that share a group, once each (once=False: for each group); nodes may be in several."""
    rows = membership.select(F.col(node).alias("n"), F.col(group).alias("g"), *keep).distinct()
    a, b = rows.select("g", F.col("n").alias("n1"), *[F.col(k).alias(f"{k}1") for k in keep]), rows.select("g", F.col("n").alias("n2"), *[F.col(k).alias(f"{k}2") for k in keep])
    met = a.join(b, "g").filter("n1 < n2").drop("g")
    return met.distinct() if once else met


def pair_counts(computed: DataFrame, expected: DataFrame | None = None, shared: bool = False) -> DataFrame:
    """One row tp, computed, expected: how many different pairs of nodes share a group of the one clustering, the other or both (node,
    cid; nodes may be in several groups). shared: only nodes of both count.

    Pairs are counted from the sizes of groups, and those of both from the sizes of cells (a group of each). A pair that shares
    two groups of a clustering is counted once too often: two of its groups then have two nodes in common. Those are found by
    the nodes' pairs of groups, where these are fewer than the pairs of nodes, and their pairs alone are listed.
    """
    spark, kinds = computed.sparkSession, {dict(x.dtypes)["cid"] for x in (computed, expected) if x is not None}
    g = F.col("cid").cast("string") if len(kinds) > 1 else F.col("cid")
    rows = computed.select(F.col("node").alias("n"), g.alias("g"), F.lit(1).alias("side"))
    if expected is not None:
        rows = rows.unionByName(expected.select(F.col("node").alias("n"), g.alias("g"), F.lit(2).alias("side")))
    groups = lambda k: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("g"))))
    held = rows.filter("n is not null").repartition(width(spark, rows), "n").groupBy("n").agg(groups(1).alias("a"), groups(2).alias("b"), F.min("side").alias("x"), F.max("side").alias("y"))
    held = cut((held.filter("x <> y") if shared else held).drop("x", "y"))
    sizes = [held.select(F.explode(k).alias("g")).groupBy("g").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0] for k in "ab"]
    da, db = F.size("a").cast("long"), F.size("b").cast("long")
    if (held.agg(F.sum(da * da + db * db + da * db)).first()[0] or 0) > 4 * sum(sizes):
        a, b = (pairs(held.select("n", F.explode(k).alias("g")), "n", "g").withColumn("side", F.lit(s)) for k, s in (("a", 1), ("b", 2)))
        both = a.unionByName(b).groupBy("n1", "n2").agg(F.min("side").alias("x"), F.max("side").alias("y"))
        return both.agg(F.count(F.expr("case when x < y then 1 end")).alias("tp"), F.count(F.expr("case when x = 1 then 1 end")).alias("computed"), F.count(F.expr("case when y = 2 then 1 end")).alias("expected"))
    n = width(spark, rows)
    cells = held.select("b", F.explode("a").alias("g")).select("g", F.explode("b").alias("h")).repartition(n, "g", "h").groupBy("g", "h").agg(F.count("*").alias("n"))
    met = cells.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("met"))
    own = [held.filter(F.size(k) > 1).select("n", k, F.explode(k).alias("g")).select(F.lit(k).alias("k"), "n", "g", F.explode(k).alias("h")).filter("g < h") for k in "ab"]
    twice = own[0].unionByName(own[1]).repartition(n, "g", "h").withColumn("c", F.count("*").over(Window.partitionBy("k", "g", "h"))).filter("c > 1")
    twice = cut(twice.drop("c"))
    often = twice.withColumnRenamed("n", "n1").join(twice.withColumnRenamed("n", "n2"), ["k", "g", "h"]).filter("n1 < n2").select("n1", "n2").distinct()
    for s in "12":
        often = often.join(held.withColumnsRenamed({c: c + s for c in "nab"}), f"n{s}")
    listed = often.select(F.size(F.array_intersect("a1", "a2")).cast("long").alias("a"), F.size(F.array_intersect("b1", "b2")).cast("long").alias("b"))
    more = {"tp": F.expr("a * b - least(a, 1) * least(b, 1)"), "computed": F.expr("a - least(a, 1)"), "expected": F.expr("b - least(b, 1)")}
    over = listed.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in more.items()])
    return met.crossJoin(over).select((F.col("met") - F.col("tp")).alias("tp"), (F.lit(sizes[0]) - F.col("computed")).alias("computed"), (F.lit(sizes[1]) - F.col("expected")).alias("expected"))


def schema_level(computed: DataFrame, expected: DataFrame, weights: DataFrame | None = None, pair_filter: Column | None = None) -> DataFrame:
    """Metrics over attribute pairs; both have node, cid. weights: node, occs, of which a pair weighs the least."""
    if weights is None and pair_filter is None:
        return metrics(pair_counts(computed, expected, shared=True))
    shared = computed.select("node").intersect(expected.select("node"))
    a, b = (pairs(x.join(shared, "node", "left_semi"), "node", "cid") for x in (computed, expected))
    if pair_filter is not None:
        a, b = a.filter(pair_filter), b.filter(pair_filter)
    both = a.withColumn("c", F.lit(1)).join(b.withColumn("e", F.lit(1)), ["n1", "n2"], "full_outer")
    weight = F.lit(1)
    if weights is not None:
        both = both.join(weights.select(F.col("node").alias("n1"), F.col("occs").alias("o1")), "n1").join(weights.select(F.col("node").alias("n2"), F.col("occs").alias("o2")), "n2")
        weight = F.least("o1", "o2")
    counts = both.agg(*[F.coalesce(F.sum(F.when(c, weight)), F.lit(0)).alias(n) for n, c in (("tp", F.expr("c = 1 and e = 1")), ("computed", F.expr("c = 1")), ("expected", F.expr("e = 1")))])
    return metrics(counts)


def instance_level(computed: DataFrame, expected: DataFrame, conservative: bool = False) -> DataFrame:
    """Metrics over pairs of provenances (url, site, name) that share a target; conservative: whose target sets are equal.

    Expected ones count as far as their attribute has any computed target, computed ones as far as they are expected.
    """
    prov = F.concat_ws("\u0001", "site", "url", "name")
    held = computed.select("site", "name").distinct()
    e = expected.join(held, ["site", "name"], "left_semi").select(prov.alias("node"), F.col("target").alias("cid")).distinct()
    c = computed.select(prov.alias("node"), F.col("target").alias("cid")).distinct().join(e.select("node").distinct(), "node", "left_semi")
    if conservative:
        whole = lambda x: x.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set(F.col("cid").cast("string"))), "\u0001").alias("cid"))
        e, c = whole(e), whole(c)
    a, b = pairs(c, "node", "cid"), pairs(e, "node", "cid")
    both = a.withColumn("c", F.lit(1)).join(b.withColumn("e", F.lit(1)), ["n1", "n2"], "full_outer")
    return metrics(both.agg(F.count(F.expr("case when c = 1 and e = 1 then 1 end")).alias("tp"), F.count("c").alias("computed"), F.count("e").alias("expected")))


def best_targets(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each expected target the computed one of the best F among those that overlap; both have node, cid."""
    met = expected.withColumnRenamed("cid", "target").join(computed.withColumnRenamed("cid", "found"), "node").groupBy("target", "found").agg(F.count("*").alias("tp"))
    sized = met.join(expected.groupBy(F.col("cid").alias("target")).agg(F.count("*").alias("expected")), "target").join(computed.groupBy(F.col("cid").alias("found")).agg(F.count("*").alias("computed")), "found")
    w = Window.partitionBy("target").orderBy(F.col("f").desc(), "found")
    best = metrics(sized).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return expected.select(F.col("cid").alias("target")).distinct().join(best, "target", "left").na.fill(0.0, ["p", "r", "f"])


def comparison_rows(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows node, cid, real: a node's computed and expected clusters side by side, in order of the pairs' frequency; those
    left over stand alone."""
    met = computed.join(expected.withColumnRenamed("cid", "real"), "node").groupBy("cid", "real").agg(F.count("*").alias("n"))
    both = computed.join(expected.withColumnRenamed("cid", "real"), "node").join(met, ["cid", "real"])
    rows = both.withColumn("a", F.row_number().over(Window.partitionBy("node", "cid").orderBy(F.col("n").desc(), "real"))).withColumn("b", F.row_number().over(Window.partitionBy("node", "real").orderBy(F.col("n").desc(), "cid")))
    paired = rows.filter("a = 1 and b = 1").select("node", "cid", "real")
    left = computed.join(paired, ["node", "cid"], "left_anti").select("node", "cid", F.lit(None).cast("string").alias("real"))
    right = expected.withColumnRenamed("cid", "real").join(paired, ["node", "real"], "left_anti").select("node", F.lit(None).cast("string").alias("cid"), "real")
    return paired.select("node", F.col("cid").cast("string"), F.col("real").cast("string")).unionByName(left.withColumn("cid", F.col("cid").cast("string"))).unionByName(right.withColumn("real", F.col("real").cast("string")))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both, in a alone and in b alone, of two tables of the same columns, as sets."""
    keys = a.columns
    both = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), keys, "full_outer")
    return both.agg(F.count(F.expr("case when __a = 1 and __b = 1 then 1 end")).alias("tp"), F.count(F.expr("case when __b is null then 1 end")).alias("fp"), F.count(F.expr("case when __a is null then 1 end")).alias("fn"))


def predicate_names(truth: DataFrame) -> DataFrame:
    """Targets with more than one predicate name: an inconsistent ground truth."""
    return truth.groupBy("target").agg(F.countDistinct("predicate_name").alias("names")).filter("names > 1")


def prefixes(computed: DataFrame, expected: DataFrame, order: DataFrame) -> DataFrame:
    """Schema-level counts after each source, in order (site, place): pairs both of whose sources have come; nodes carry site."""
    def upto(x: DataFrame, name: str) -> DataFrame:
        p = pairs(x.join(order, "site"), "node", "cid", ["place"])
        return p.select("n1", "n2", F.greatest("place1", "place2").alias("place"), F.lit(1).alias(name))

    both = upto(computed, "c").join(upto(expected, "e"), ["n1", "n2", "place"], "full_outer")
    step = both.groupBy("place").agg(F.count(F.expr("case when c = 1 and e = 1 then 1 end")).alias("tp"), F.count("c").alias("computed"), F.count("e").alias("expected"))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    return metrics(order.select("place").distinct().join(step, "place", "left").na.fill(0).select("place", *[F.sum(c).over(w).alias(c) for c in ("tp", "computed", "expected")]))


def union_level(first: DataFrame, second: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics of the pairs of either of two clusterings (node, cid) against the expected ones."""
    # A group of either is a group of one clustering, in which nodes are in several.
    either = [x.select("node", F.concat(F.lit(k), F.col("cid").cast("string")).alias("cid")) for k, x in (("1:", first), ("2:", second))]
    return metrics(pair_counts(either[0].unionByName(either[1]), expected))


def pairs_apart(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of one of two clusterings (node, cid) that the other doesn't have: n1, n2, only_in (1 or 2)."""
    both = [pairs(x, "node", "cid", once=False).withColumn("side", F.lit(k)) for k, x in ((1, first), (2, second))]
    # Each pair meets itself by one exchange, in partitions of a number that doesn't fall with their compressed bytes.
    n = width(first.sparkSession, first.select("node").union(second.select("node")))
    sides = both[0].unionByName(both[1]).repartition(n, "n1", "n2").groupBy("n1", "n2").agg(F.min("side").alias("only_in"), F.max("side").alias("y"))
    return sides.filter("only_in = y").drop("y")


def partitioned(computed: DataFrame, expected: DataFrame, parts: DataFrame) -> DataFrame:
    """Metrics over attribute pairs by part: a pair is of a part if both its nodes are. parts: node, part."""
    named = parts.select("node", "part")
    a, b = (pairs(x.join(named, "node").withColumn("g", F.struct("part", "cid")), "node", "g", ["part"]).select("n1", "n2", F.col("part1").alias("part")) for x in (computed, expected))
    met = a.withColumn("c", F.lit(1)).join(b.withColumn("e", F.lit(1)), ["n1", "n2", "part"], "full_outer")
    return metrics(met.groupBy("part").agg(F.count(F.expr("case when c = 1 and e = 1 then 1 end")).alias("tp"), F.count("c").alias("computed"), F.count("e").alias("expected")))
