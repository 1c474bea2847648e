"""Clusters of nodes from weighted edges (n1, n2, weight), and what is done with them.

The greedy clustering takes edges from the heaviest down and asks a rule before it joins anything. Its decisions never
look outside a connected component, so components are found first and each is clustered by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators.shared import components, cut, numbered, width

EDGE = ["n1", "n2", "weight"]
EDGE_ORDER = ["weight", "n1", "n2"]


def greedy(rows: pd.DataFrame, info: dict[str, tuple[frozenset, bool, str]], rule: str) -> list[tuple[str, int]]:
    """decide() of edges in any order."""
    ordered = rows.sort_values(["weight", "n1", "n2"], ascending=False)
    return decide(zip(ordered["n1"], ordered["n2"]), info, rule)


def decide(ordered: Iterable[tuple[str, str]], info: dict[str, tuple[frozenset, bool, str]], rule: str) -> list[tuple[str, int]]:
    """(node, number of the edge that founded its cluster) of one component, of which the heaviest edges come first.

    info: of a node the pages it is on, whether it is of a master source, and its source. rule: `same_page` (no two nodes of
    one page, one master at most), `source` (one node of a source at most) or `free`.
    """
    group_of: dict[str, int] = {}
    members: dict[int, list[str]] = {}
    held: dict[int, tuple[set, int]] = {}  # what a new member mustn't share, and how many masters there are
    founded: dict[int, int] = {}
    fresh = 0

    def alone(x: str) -> tuple[set, int]:
        pages, master, source = info[x]
        return {"free": set, "source": lambda: {source}, "same_page": lambda: set(pages)}[rule](), int(master)

    def compatible(a: tuple[set, int], b: tuple[set, int]) -> bool:
        return rule == "free" or (a[0].isdisjoint(b[0]) and (rule == "source" or a[1] + b[1] <= 1))

    for k, (x, y) in enumerate(ordered):
        gx, gy = group_of.get(x), group_of.get(y)
        if gx is not None and gx == gy:
            continue
        a, b = held[gx] if gx is not None else alone(x), held[gy] if gy is not None else alone(y)
        if not compatible(a, b):
            continue
        first = min([founded[g] for g in (gx, gy) if g is not None], default=k)
        # The smaller group joins the larger, so a node moves a logarithmic number of times.
        for node, g, facts in ((x, gx, a), (y, gy, b)):
            if g is None:
                fresh += 1
                group_of[node], members[fresh], held[fresh] = fresh, [node], facts
        gx, gy = group_of[x], group_of[y]
        if len(members[gx]) < len(members[gy]):
            gx, gy = gy, gx
        for node in members[gy]:
            group_of[node] = gx
        members[gx] += members.pop(gy)
        more, masters = held.pop(gy)
        whole, count = held[gx]
        if len(whole) < len(more):
            whole, more = more, whole
        whole |= more
        held[gx] = whole, count + masters
        founded.pop(gy, None)
        founded[gx] = first
    return [(node, founded[g]) for node, g in group_of.items()]


def cluster(edges: DataFrame, nodes: DataFrame, rule: str = "same_page") -> DataFrame:
    """Columns cid, node of the nodes that are in a cluster; cid counts from 0 in order of each cluster's founding edge.

    nodes: node, source, master (boolean), urls (array); a generated node of which pages aren't to count has none.
    """
    edges = cut(edges)
    roots = components(edges)
    heaviest = [F.col("weight").desc(), F.col("n1").desc(), F.col("n2").desc()]
    if rule == "free":
        first = edges.join(roots, edges.n1 == roots.node).select("root", *EDGE).groupBy("root").agg(F.max(F.struct("weight", "n1", "n2")).alias("e"))
        named = numbered(first.select("root", "e.*"), heaviest, "cid").select("root", "cid")
        return roots.join(named, "root").select(F.col("cid").cast("long").alias("cid"), "node")
    # Components come to their task one after another, of each first the nodes and then the edges, so that many small ones cost no
    # more than their rows.
    own = edges.join(roots.withColumnRenamed("node", "n1"), "n1").select("root", F.lit(1).alias("kind"), *EDGE)
    facts = roots.join(nodes.select("node", "source", "master", "urls"), "node").select("root", F.lit(0).alias("kind"), "node", "source", "master", "urls")
    rows = facts.unionByName(own, allowMissingColumns=True).repartition(width(edges.sparkSession), "root")
    order = F.nanvl("weight", F.lit(None).cast("double")).desc_nulls_last()
    none: tuple[frozenset, bool, str] = (frozenset(), False, "")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        root, info, held, out = None, {}, [], []

        def done() -> None:
            if held:
                for _, x, y in held:
                    info.setdefault(x, none), info.setdefault(y, none)
                out.extend((node, *held[k]) for node, k in decide(((x, y) for _, x, y in held), info, rule))
            info.clear(), held.clear()

        def made() -> pd.DataFrame:
            table = pd.DataFrame(out, columns=["node", "weight", "n1", "n2"])
            out.clear()
            return table

        for batch in batches:
            for r, kind, node, source, master, urls, weight, n1, n2 in zip(*(batch[c] for c in ("root", "kind", "node", "source", "master", "urls", *EDGE_ORDER))):
                if r != root:
                    done()
                    root = r
                if kind:
                    held.append((weight, n1, n2))
                else:
                    info[node] = frozenset(urls if urls is not None else ()), bool(master), source
            if out:
                yield made()
        done()
        if out:
            yield made()

    found = cut(rows.sortWithinPartitions("root", "kind", order, F.col("n1").desc(), F.col("n2").desc()).mapInPandas(run, "node string, weight double, n1 string, n2 string"))
    founders = numbered(found.select("weight", "n1", "n2").distinct(), heaviest, "cid")
    return found.join(founders, ["weight", "n1", "n2"]).select(F.col("cid").cast("long").alias("cid"), "node")


def isolated(clustered: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("node").join(clustered, "node", "left_anti")


def clique_edges(groups: DataFrame, group: str, node: str, weight: float) -> DataFrame:
    """Edges between all nodes of a group."""
    rows = groups.select(F.col(group).alias("g"), F.col(node).alias("n")).distinct()
    return rows.withColumnRenamed("n", "n1").join(rows.withColumnRenamed("n", "n2"), "g").filter("n1 < n2").select("n1", "n2", F.lit(weight).alias("weight")).distinct()


def bipartite_edges(groups: DataFrame, group: str, node: str, side: str, weight: float) -> DataFrame:
    """Edges between the nodes of different sides of a group."""
    rows = groups.select(F.col(group).alias("g"), F.col(node).alias("n"), F.col(side).alias("s")).distinct()
    left, right = rows.select("g", F.col("n").alias("x"), F.col("s").alias("sx")), rows.select("g", F.col("n").alias("y"), F.col("s").alias("sy"))
    return left.join(right, "g").filter("sx < sy").select(F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2"), F.lit(weight).alias("weight")).distinct()


def aggregate(old: DataFrame, new_edges: DataFrame, nodes: DataFrame, rule: str, score: float) -> DataFrame:
    """An old clustering (cid, node) with new edges of sources that differ: its pairs weigh 2, new ones `score`."""
    held = clique_edges(old, "cid", "node", 2.0)
    source = nodes.select("node", "source")
    across = new_edges.join(source.withColumnsRenamed({"node": "n1", "source": "s1"}), "n1").join(source.withColumnsRenamed({"node": "n2", "source": "s2"}), "n2").filter("s1 <> s2").select("n1", "n2", F.lit(score).alias("weight"))
    return cluster(held.unionByName(across).groupBy("n1", "n2").agg(F.max("weight").alias("weight")), nodes, rule)


def cluster_pairs(clustered: DataFrame) -> DataFrame:
    """Unordered pairs of nodes that share a cluster."""
    return clique_edges(clustered, "cid", "node", 1.0).select("n1", "n2")


def evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs kept, new and deleted from one clustering to the next."""
    a, b = cluster_pairs(before).withColumn("a", F.lit(1)), cluster_pairs(after).withColumn("b", F.lit(1))
    met = a.join(b, ["n1", "n2"], "full_outer")
    return met.agg(F.count(F.expr("case when a = 1 and b = 1 then 1 end")).alias("kept"), F.count(F.expr("case when a is null then 1 end")).alias("added"), F.count(F.expr("case when b is null then 1 end")).alias("deleted"))


def same_clusters(before: DataFrame, after: DataFrame) -> float:
    """The part of the clusters of both that are identical."""
    shape = lambda c: c.groupBy("cid").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("node")), "\u0001"), 256).alias("h")).select("h").distinct()
    a, b = shape(before), shape(after)
    both, all_ = a.intersect(b).count(), a.union(b).distinct().count()
    return both / all_ if all_ else 1.0


def paired_overlap(before: DataFrame, after: DataFrame) -> float:
    """Clusters paired one to one, the largest overlap first: the sum of overlaps over the larger number of nodes."""
    met = cut(before.withColumnRenamed("cid", "c1").join(after.withColumnRenamed("cid", "c2"), "node").groupBy("c1", "c2").agg(F.count("*").alias("n")))
    total = 0
    while True:
        # A pair that is the first of both its clusters is what the greedy order takes of them.
        by = [F.col("n").desc(), "c1", "c2"]
        best = met.withColumn("a", F.row_number().over(Window.partitionBy("c1").orderBy(*by))).withColumn("b", F.row_number().over(Window.partitionBy("c2").orderBy(*by))).filter("a = 1 and b = 1").select("c1", "c2", "n")
        best = cut(best)
        overlap = best.agg(F.sum("n")).first()[0]
        if overlap is None:
            break
        total += overlap
        met = cut(met.join(best, "c1", "left_anti").join(best, "c2", "left_anti"))
    most = max(before.count(), after.count())
    return total / most if most else 1.0


def name_of(clustered: DataFrame, claims_nodes: DataFrame) -> DataFrame:
    """Columns cid, label: the most frequent original attribute name of the cluster, ties by alphabet, '' if none.

    claims_nodes: node, name.
    """
    names = clustered.join(claims_nodes, "node").groupBy("cid", T.original_name(F.col("name")).alias("n")).agg(F.count("*").alias("c"))
    best = names.groupBy("cid").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("n"))).alias("b"))
    return clustered.select("cid").distinct().join(best, "cid", "left").select("cid", F.coalesce("b.n", F.lit("")).alias("label"))


def top_names(clustered: DataFrame, claims_nodes: DataFrame, k: int = 3) -> DataFrame:
    """Columns cid, names: the k most frequent names of a cluster, those whose words extend a kept one's put last."""
    names = clustered.join(claims_nodes, "node").groupBy("cid", T.original_name(F.col("name")).alias("n")).agg(F.count("*").alias("c"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, late = [], []
        for name in rows.sort_values(["c", "n"], ascending=[False, True])["n"]:
            (late if any(name.split() <= x.split() for x in kept) else kept).append(name)
        return pd.DataFrame([(rows["cid"].iloc[0], (kept + late)[:k])], columns=["cid", "names"])

    return names.groupBy("cid").applyInPandas(run, "cid long, names array<string>")


def frequent_name_edges(clustered: DataFrame, claims_nodes: DataFrame, least: int = 2, share: float = 0.33) -> DataFrame:
    """Edges of weight 1 by folded original names in a category: between isolated attributes of a name, between the least nodes of
    clusters in which a name is frequent (`least` times and this part of the cluster), and from one of these to an isolated one.

    claims_nodes: node, name, category.
    """
    folded = claims_nodes.select("name").distinct().select("name", T.fold(T.original_name(F.col("name"))).alias("folded"))
    rows = claims_nodes.join(folded, "name").withColumn("g", F.concat_ws("//", "category", "folded"))
    size = clustered.groupBy("cid").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    seen = clustered.join(rows, "node").groupBy("cid", "g").agg(F.count("*").alias("c")).join(size, "cid")
    heads = seen.filter((F.col("c") >= least) & (F.col("c") >= share * F.col("n"))).select("g", F.col("least").alias("node"))
    single = rows.join(clustered, "node", "left_anti").filter(~T.is_virtual(F.col("name"))).select("g", "node")
    across = heads.groupBy("g").agg(F.min("node").alias("x")).join(single.groupBy("g").agg(F.min("node").alias("y")), "g")
    found = clique_edges(heads, "g", "node", 1.0).unionByName(clique_edges(single, "g", "node", 1.0))
    return found.unionByName(across.select(F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2"), F.lit(1.0).alias("weight"))).distinct()


def by_name(claims: DataFrame, frequent: bool = False, least: int = 7, most_attributes: int = 7) -> DataFrame:
    """Baseline: edges of weight 2 between attributes of a name (in a category); frequent: and of weight 1 between those
    that share a frequent but rare value: more than `least` times or on half of the attribute, in few attributes."""
    node = F.concat_ws("//", "category", "site", "name")
    names = claims.select("category", F.col("name").alias("n"), node.alias("node")).distinct()
    edges = clique_edges(names.withColumn("g", F.concat_ws("//", "category", "n")), "g", "node", 2.0)
    if not frequent:
        return edges
    spread = claims.groupBy("category", "value").agg(F.countDistinct("site", "name").alias("attrs")).filter(F.col("attrs") <= most_attributes)
    size = claims.groupBy("category", "site", "name").agg(F.count("*").alias("n"))
    often = claims.groupBy("category", "site", "name", "value").agg(F.count("*").alias("c")).join(size, ["category", "site", "name"]).filter((F.col("c") > least) | (F.col("c") > 0.5 * F.col("n")))
    rare = often.join(spread, ["category", "value"]).select(F.sha2(F.concat_ws("\u0001", "category", F.col("value").cast("string")), 256).alias("g"), node.alias("node"))
    return edges.unionByName(clique_edges(rare, "g", "node", 1.0)).groupBy("n1", "n2").agg(F.max("weight").alias("weight"))


def by_similar_names(nodes: DataFrame, clustered: DataFrame, claims: DataFrame, contained: float = 0.8, real_names: bool = False, blacklist: bool = False) -> DataFrame:
    """Full name grouping: the old clusters' pairs weigh 2; clusters and isolated attributes that have a name in common, as a
    token set, are joined where the tokens of their domains are contained in each other to more than `contained` (weighted),
    and their edges weigh as much. An isolated attribute with a virtual one in a cluster isn't joined.

    nodes: node, category, site, name; claims: node, value (token sets). real_names: names of virtual attributes don't count;
    blacklist: nor do names of an isolated attribute with a virtual one in a cluster.
    """
    words = F.array_join(F.array_sort(F.array_distinct(F.split(F.when(F.col("cid").isNull(), F.col("name")).otherwise(T.original_name(F.col("name"))), " +"))), " ")
    rows = nodes.select("node", "category", "site", "name").join(clustered, "node", "left")
    rows = rows.withColumn("g", F.concat_ws("//", "category", words)).withColumn("item", F.coalesce(F.concat(F.lit("c"), F.col("cid").cast("string")), F.concat(F.lit("n"), F.col("node"))))
    rows = cut(rows)  # it is read six times
    split = rows.filter(F.col("cid").isNotNull() & T.is_virtual(F.col("name"))).select("category", "site", T.original_name(F.col("name")).alias("name")).distinct()
    gone = rows.filter(F.col("cid").isNull()).join(split, ["category", "site", "name"], "left_semi").select("node", "g")
    items = rows.join(gone.select("node"), "node", "left_anti")
    if real_names:
        items = items.filter(F.col("cid").isNull() | ~T.is_virtual(F.col("name")))
    if blacklist:
        items = items.join(gone.select("g").distinct(), "g", "left_anti")
    named = items.select("g", "item").distinct()
    a, b = named.withColumnRenamed("item", "i1"), named.withColumnRenamed("item", "i2")
    pairs = cut(a.join(b, "g").filter("i1 < i2").select("i1", "i2").distinct())
    domain = cut(claims.select("node", F.explode("value").alias("t")).join(rows.select("node", "item"), "node").groupBy("item").agg(F.array_sort(F.collect_set("t")).alias("d")))
    alike = pairs.join(domain.withColumnsRenamed({"item": "i1", "d": "d1"}), "i1").join(domain.withColumnsRenamed({"item": "i2", "d": "d2"}), "i2")
    alike = cut(alike.select("i1", "i2", F.round(T.weighted_containment(F.col("d1"), F.col("d2")), 12).alias("weight"))).filter(F.col("weight") > contained)
    held = rows.select("item", "node")
    across = alike.join(held.withColumnsRenamed({"item": "i1", "node": "x"}), "i1").join(held.withColumnsRenamed({"item": "i2", "node": "y"}), "i2").select(F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2"), "weight")
    return clique_edges(clustered, "cid", "node", 2.0).unionByName(across).groupBy("n1", "n2").agg(F.max("weight").alias("weight"))


def with_master(clustered: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Clusters with a node of a master source or of `least` nodes."""
    held = clustered.join(nodes.select("node", "master"), "node").groupBy("cid").agg(F.max(F.col("master").cast("int")).alias("m"), F.count("*").alias("n"))
    return clustered.join(held.filter((F.col("m") == 1) | (F.col("n") >= least)), "cid", "left_semi")


Scorer = Callable[[DataFrame], DataFrame]


def external(pairs: DataFrame, scorer: Scorer, least: float) -> DataFrame:
    """Edges of an external matcher: scorer takes candidate pairs (n1, n2) and returns them with a weight."""
    return scorer(pairs).filter(F.col("weight") > least).select(*EDGE)
