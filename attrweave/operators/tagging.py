"""Composite values: a dictionary of known values, tags where it occurs in long ones, and virtual attributes of the tags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators.shared import beside
from attrweave.operators.claims import contained_sets, head_tail


def dictionary(clustered: DataFrame, claims: DataFrame, shortest: int = 2, longest: int = 50, least: int = 2, rarity: float = 0.5, source: DataFrame | None = None) -> DataFrame:
    """Columns value, clusters (sorted): values of some length that `least` original attributes of a cluster have, in few clusters.

    clustered: cid, node; claims: node, name, value (folded text); source: the clusters (cid) whose values count, all if none.
    """
    rows = claims.filter(~T.is_virtual(F.col("name")) & F.length("value").between(shortest, longest))
    rows = beside(rows.select("node", "value").distinct(), clustered, ["node"], ["value"], "left")
    held = rows.filter("cid is not null").groupBy("cid", "value").agg(F.countDistinct("node").alias("n")).filter(F.col("n") >= least)
    if source is not None:
        held = held.join(source, "cid", "left_semi")
    whole = rows.select("cid", "node").distinct().agg((F.countDistinct("cid") + F.countDistinct(F.when(F.col("cid").isNull(), F.col("node")))).alias("whole"))
    known = held.groupBy("value").agg(F.array_sort(F.collect_set("cid")).alias("clusters"))
    return known.crossJoin(F.broadcast(whole)).filter(F.size("clusters") / F.col("whole") <= rarity).select("value", "clusters")


def grams(values: DataFrame, most: int = 10, least: int = 1) -> DataFrame:
    """Columns value, place, n, gram of the n-grams of different values."""
    words = values.select("value").distinct().withColumn("words", F.split("value", " "))
    each = [words.select("value", F.lit(n).alias("n"), F.posexplode(F.transform(T.ngrams(F.col("words"), n), lambda g: F.array_join(g, " "))).alias("place", "gram")) for n in range(least, most + 1)]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def tag_all(values: DataFrame, known: DataFrame, most: int = 10, least: int = 1) -> DataFrame:
    """Every n-gram that is in the dictionary: value, own (cluster or null), gram, cluster; values has value, own."""
    hits = grams(values, most, least).join(known.withColumnRenamed("value", "gram"), "gram").select("value", "place", "n", "gram", F.explode("clusters").alias("cluster"))
    return values.select("value", "own").distinct().join(hits, "value").filter(~F.col("cluster").eqNullSafe(F.col("own"))).select("value", "own", "place", "gram", "cluster")


def longest_first(words: list[str], known: dict[str, tuple], own: object, most: int = 10, least: int = 1) -> list[tuple[str, tuple]]:
    """Grams of a value, the longest and leftmost first; what is left of and right of a gram is searched in turn."""
    out, todo = [], [(0, len(words))]
    while todo:
        start, stop = todo.pop()
        hit = None
        for n in range(min(most, stop - start), least - 1, -1):
            for at in range(start, stop - n + 1):
                clusters = known.get(" ".join(words[at : at + n]))
                if clusters and clusters != (own,):
                    hit = at, n, tuple(c for c in clusters if c != own)
                    break
            if hit:
                break
        if hit:
            at, n, clusters = hit
            out.append((at, " ".join(words[at : at + n]), clusters))
            todo += [(at + n, stop), (start, at)]
    return [(gram, clusters) for _, gram, clusters in sorted(out)]


def tag_longest(values: DataFrame, known: DataFrame, most: int = 10, least: int = 1) -> DataFrame:
    """Columns value, own, gram, cluster by longest_first(), on different (value, own).

    Only entries of the dictionary that occur in a value come to it, by a join on n-grams, so it is never sent whole.
    """
    hits = grams(values, most, least).join(known.withColumnRenamed("value", "gram"), "gram").groupBy("value").agg(F.collect_set(F.struct("gram", "clusters")).alias("known"))
    rows = values.select("value", "own").distinct().join(hits, "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for value, own, entries in zip(part["value"], part["own"], part["known"]):
                own = None if pd.isna(own) else int(own)
                table = {e["gram"]: tuple(int(c) for c in e["clusters"]) for e in entries}
                for gram, clusters in longest_first(value.split(" "), table, own, most, least):
                    out += [(value, own, gram, c) for c in clusters]
            yield pd.DataFrame(out, columns=["value", "own", "gram", "cluster"]).astype({"own": "Int64", "cluster": "Int64"})

    return rows.mapInPandas(run, "value string, own long, gram string, cluster long")


def shared_out(grams_of: dict[int, set[str]], one_cluster: bool) -> list[tuple[int, str]]:
    """(cluster, its sorted grams): clusters of the fewest grams first, those of as few together; one_cluster: grams that are
    used up don't count for later ones."""
    left, used, out = {c: set(g) for c, g in grams_of.items()}, set(), []
    while left:
        if one_cluster:
            left = {c: g - used for c, g in left.items()}
        fewest = min(map(len, left.values()))
        for c in sorted(c for c, g in left.items() if len(g) == fewest):
            g = left.pop(c)
            if g:
                out.append((c, " ".join(sorted(g))))
                used |= g
    return out


def snippets(tags: DataFrame, one_cluster: bool = False) -> DataFrame:
    """Columns value, own, cluster, snippet of tagged values by shared_out()."""
    sets = tags.groupBy("value", "own").agg(F.collect_set(F.struct("cluster", "gram")).alias("found"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for value, own, found in zip(part["value"], part["own"], part["found"]):
                grams_of: dict[int, set[str]] = {}
                for x in found:
                    grams_of.setdefault(int(x["cluster"]), set()).add(x["gram"])
                out += [(value, None if pd.isna(own) else int(own), c, g) for c, g in shared_out(grams_of, one_cluster)]
            yield pd.DataFrame(out, columns=["value", "own", "cluster", "snippet"]).astype({"own": "Int64", "cluster": "Int64"})

    return sets.mapInPandas(run, "value string, own long, cluster long, snippet string")


def virtual_claims(claims: DataFrame, tags: DataFrame, one_cluster: bool = False) -> DataFrame:
    """Claims of virtual attributes `name#-#cluster`: the sorted grams of a value that are tagged with the cluster.

    one_cluster: a gram counts for the cluster with the fewest grams of the value alone. claims: site, category, url, name,
    value, own.
    """
    named = snippets(tags, one_cluster).withColumnsRenamed({"value": "v", "own": "o"})
    met = claims.join(named, (claims.value == F.col("v")) & claims.own.eqNullSafe(F.col("o")))
    return met.select("site", "category", "url", F.concat("name", F.lit(T.SEPARATOR), F.col("cluster").cast("string")).alias("name"), F.col("snippet").alias("value"))


def filter_virtual(virtual: DataFrame, claims: DataFrame, known: DataFrame, ratio: float = 0.1, least: int = 2, score: float = 1.0, most_alike: float = 0.8) -> DataFrame:
    """Virtual claims of attributes that are large and varied enough, not copies of each other, nor of their original."""
    sa = ["site", "category", "name"]
    v = virtual.withColumn("orig", T.original_name(F.col("name")))
    shape = v.groupBy(*sa, "orig").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\u0001", "url", "value"))), "\u0002"), 256).alias("h"), F.count("*").alias("n"))
    first = shape.groupBy("site", "category", "orig", "h").agg(F.min("name").alias("name"))
    size = claims.groupBy("site", "category", F.col("name").alias("orig")).agg(F.count("*").alias("whole"))
    sized = shape.join(first.select(*sa), sa, "left_semi").join(size, ["site", "category", "orig"]).filter((F.col("n") / F.col("whole") > ratio) & (F.col("n") >= least))
    worth = known.select("value", (1 / F.size("clusters")).alias("w"))
    scores = v.select(*sa, "value").distinct().join(worth, "value", "left").groupBy(*sa).agg(F.sum(F.coalesce("w", F.lit(0.5))).alias("score")).filter(F.col("score") >= score)
    kept = sized.join(scores, sa)
    mine = v.groupBy(*sa, "orig", "value").agg(F.count("*").alias("a")).join(kept.select(*sa), sa, "left_semi")
    theirs = claims.groupBy("site", "category", F.col("name").alias("orig"), "value").agg(F.count("*").alias("b"))
    both = mine.join(theirs, ["site", "category", "orig", "value"]).groupBy(*sa).agg(F.sum(F.least("a", "b")).alias("common"))
    fresh = kept.join(both, sa, "left").withColumn("common", F.coalesce("common", F.lit(0))).filter(F.col("common") / (F.col("n") + F.col("whole") - F.col("common")) <= most_alike)
    return virtual.join(fresh.select(*sa), sa, "left_semi")


def atomic(clustered: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, atomic: nodes of the clusters that have most of the sources (the head); isolated nodes never are."""
    sources = clustered.join(nodes, "node").groupBy("cid").agg(F.countDistinct("source").alias("sources"))
    parts = head_tail(sources, "sources").select("cid", "part")
    held = clustered.join(parts, "cid").select("node", (F.col("part") == "HEAD").alias("atomic"))
    return nodes.select("node").join(held, "node", "left").select("node", F.coalesce("atomic", F.lit(False)).alias("atomic"))


def clear_output(clustered: DataFrame, nodes: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Clusters without virtual nodes that add nothing: clusters of virtual nodes alone whose originals are all in one cluster,
    virtual nodes whose original is in their cluster, and those on part of the pages of another of the same original and cluster.

    nodes: node, orig (the original's node; itself if it isn't virtual); urls: node, url.
    """
    rows = clustered.join(nodes, "node")
    placed = rows.join(clustered.withColumnsRenamed({"node": "orig", "cid": "orig_cid"}), "orig", "left")
    shape = placed.groupBy("cid").agg(F.max((F.col("node") == F.col("orig")).cast("int")).alias("real"), F.countDistinct("orig_cid").alias("places"), F.max(F.col("orig_cid").isNull().cast("int")).alias("isolated"))
    kept = placed.filter((F.col("node") == F.col("orig")) | ~F.coalesce(F.col("orig_cid") == F.col("cid"), F.lit(False)))
    kept = kept.join(shape.filter("real = 1 or places <> 1 or isolated = 1"), "cid", "left_semi").select("cid", "node", "orig")
    if urls is not None:
        virtual = kept.filter("node <> orig").join(urls.select("node", "url").distinct(), "node")
        part = contained_sets(virtual.select(F.struct("cid", "node").alias("k"), F.concat_ws("\u0001", F.col("cid").cast("string"), "orig", "url").alias("e")), "k", "e")
        kept = kept.join(part.select("k.cid", "k.node"), ["cid", "node"], "left_anti")
    return kept.select("cid", "node")
