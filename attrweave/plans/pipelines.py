"""Runs: import, match, cluster, tag, again until nothing changes, and the report. MODES names the ways to do it.

The tables that a round hands on are cut from their lineage by checkpoints in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrweave.config import Options
from attrweave.functions import text as T
from attrweave.operators import claims as C
from attrweave.operators import clustering as K
from attrweave.operators import linkage as L
from attrweave.operators import matching as M
from attrweave.operators import simulation as S
from attrweave.operators import tagging as G
from attrweave.operators.shared import cut

SA = C.SA


@dataclass
class State:
    """What steps hand on: claims (with node, and value as folded text), linkage, clusters (cid, node).

    suspended: claims of pages left out of the run; initial: the linkage that the report uses.
    """

    claims: DataFrame
    linkage: DataFrame
    clusters: DataFrame | None = None
    rounds: int = 0
    suspended: DataFrame | None = None
    initial: DataFrame | None = None


class NotConverged(Exception):
    """The clusters of original attributes still changed in the last round allowed."""


def node() -> Column:
    return F.concat_ws("//", "category", "site", "name")


def nodes(claims: DataFrame, options: Options) -> DataFrame:
    """node, source, master, urls, name, category; virtual attributes have no urls where their pages don't count."""
    urls = F.collect_set("url")
    if not options.pages_of_virtual:
        urls = F.when(F.max(T.is_virtual(F.col("name")).cast("int")) == 1, F.array().cast("array<string>")).otherwise(urls)
    out = claims.groupBy(*SA).agg(urls.alias("urls"))
    master = F.col("site").isin(list(options.masters)) if options.masters else F.lit(False)
    return out.select(node().alias("node"), F.concat_ws("__", "site", "category").alias("source"), master.alias("master"), "urls", *SA)


def prepare(claims: DataFrame, linkage: DataFrame, options: Options | None = None) -> State:
    """The input as the options ask for it, values folded; fully transformed token sets are made where they are compared."""
    o = options or Options()
    rows = C.without_names(claims, list(o.excluded_names))
    if o.category:
        rows, linkage = rows.filter(F.col("category") == o.category), linkage.filter(F.col("category") == o.category)
    if o.source_rule != "NONE":
        rows = S.keep_sources(rows, linkage, max(o.sources_kept, len(o.sources_mandatory)), o.source_rule, list(o.sources_mandatory), o.seed)
        linkage = linkage.join(rows.select("site").distinct(), "site", "left_semi")
    folded = rows.select("value").distinct().select("value", T.fold(F.col("value")).alias("folded"))
    rows = cut(rows.join(folded, "value").select("site", "category", "url", "name", F.col("folded").alias("value")))
    state = State(rows, linkage, initial=linkage)
    if o.delete_unlinked:
        state.claims = cut(C.linked(rows, linkage))
        state.suspended = rows.join(linkage.select(*C.PAGE).distinct(), C.PAGE, "left_anti")
    if o.linkage_rule != "NONE":
        state.linkage = cut(S.remove_linkage(state.linkage, o.linkage_kept, o.linkage_rule, o.seed))
    if o.linkage_added > 0:
        state.linkage = cut(S.add_errors(state.linkage, state.claims, o.linkage_added, o.seed))
    return state


def restored(state: State) -> State:
    """The state with the pages that were left out and the linkage of the input, for the report."""
    if state.suspended is not None:
        state.claims = state.claims.unionByName(state.suspended)
        state.suspended = None
    state.linkage = state.initial
    return state


def _alike() -> Column:
    tokens = lambda c: F.split(c, " ")
    return T.weighted_jaccard(tokens(F.col("value1")), tokens(F.col("value2"))) >= 0.9


def transformed(state: State, options: Options) -> DataFrame:
    """The claims with the sorted token set of a value as text."""
    rows = C.transformed(state.claims, options.common_token_ratio).withColumn("value", F.array_join("value", " "))
    return cut(rows.select("site", "category", "url", "name", "value"))


def match(state: State, options: Options, scorer: K.Scorer | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Weighted edges of attributes, by Bayes or by an external matcher."""
    rows = transformed(state, options) if rows is None else rows
    common = C.common_values(rows, options.common_attributes, options.common_ratio)
    linked = rows.join(common, ["category", "value"], "left_anti").join(state.linkage, C.PAGE)
    pairs = M.candidates(linked, options.min_common_values)
    if scorer is not None:
        a, b = (F.concat_ws("//", "category", f"site{k}", f"name{k}") for k in (1, 2))
        return K.external(pairs.select(F.least(a, b).alias("n1"), F.greatest(a, b).alias("n2")), scorer, options.min_edge_weight)
    met = M.value_matches(pairs, rows.join(state.linkage, C.PAGE), options.weights)
    p = M.probabilities(met, rows, options.error_rate, options.name_weight, options.idf, options.apriori, options.posterior, _alike())
    return M.edges(p, options.min_edge_weight)


def clustered(state: State, edges: DataFrame, options: Options) -> DataFrame:
    n = nodes(state.claims, options)
    found = K.cluster(edges, n, options.rule)
    return cut(K.with_master(found, n, options.min_external) if options.masters else found)


def link_pages(state: State, options: Options, rows: DataFrame) -> DataFrame:
    """The linkage by the clusters' attributes: pages that rare values or the linkage of the input bring together, if probable."""
    if options.linkage_without_virtual:
        rows = rows.filter(~T.is_virtual(F.col("name")))
    common = C.common_values(rows, options.common_attributes, options.common_ratio)
    met = L.page_candidates(L.blocks(rows, L.rare_values(rows, common), state.initial))
    met = L.behave(met, state.linkage, options.linkage_behavior)
    held = rows.select(*SA).distinct().withColumn("node", node()).join(state.clusters, "node").select("cid", *SA)
    p = L.page_probabilities(met, rows, held, options.error_rate, options.linkage_apriori, _alike()).filter(F.col("p") >= options.min_linkage_weight)
    page = lambda k: F.concat_ws("\u0001", "category", f"site{k}", f"url{k}")
    edges = p.select(F.least(page(1), page(2)).alias("n1"), F.greatest(page(1), page(2)).alias("n2"), F.round("p", 12).alias("weight"))
    one = F.concat_ws("\u0001", "category", "site", "url")
    if options.linkage_behavior == "ADD":
        edges = edges.unionByName(K.clique_edges(state.linkage.withColumn("node", one).withColumn("g", F.concat_ws("\u0001", "category", "pid")), "g", "node", 2.0)).groupBy("n1", "n2").agg(F.max("weight").alias("weight"))
    pages = rows.select(*C.PAGE).distinct().select(one.alias("node"), F.concat_ws("__", "site", "category").alias("source"), F.lit(False).alias("master"), F.array().cast("array<string>").alias("urls"))
    found = K.cluster(edges, pages, "free" if options.linkage_same_source else "source")
    part = F.split("node", "\u0001")
    return cut(found.select(F.concat(F.lit("found-"), F.col("cid").cast("string")).alias("pid"), part[1].alias("site"), part[0].alias("category"), part[2].alias("url")))


def align(state: State, options: Options, scorer: K.Scorer | None = None) -> State:
    """Matching and record linkage in turn: until the linkage stays or the iterations are used up; the last step is matching."""
    rows, previous = transformed(state, options), None
    if options.restart_linkage:
        state.linkage = state.initial
    for k in range(1 if options.record_linkage == "NONE" else options.iterations):
        state.clusters = clustered(state, match(state, options, scorer, rows), options)
        if options.record_linkage == "NONE" or k == options.iterations - 1:
            break
        state.linkage = link_pages(state, options, rows)
        now = state.linkage.select(F.col("pid").alias("cid"), F.concat_ws("\u0001", *C.PAGE).alias("node"))
        if previous is not None and K.same_clusters(previous, now) >= options.stop_identical and K.paired_overlap(previous, now) >= options.stop_similarity:
            break
        previous = now
    return state


def group_names(state: State, options: Options) -> DataFrame:
    """Clusters and isolated attributes merged where names are equal and domains overlap; see K.by_similar_names()."""
    n = nodes(state.claims, options)
    tokens = state.claims.select(node().alias("node"), F.split("value", " ").alias("value"))
    edges = K.by_similar_names(n, state.clusters, tokens, options.containment, "EXCLUDE_SPLIT" in options.names, "BLACKLIST" in options.names)
    return cut(K.cluster(edges, n, "same_page" if options.names.startswith("SAME_PAGE") else "free"))


def tag(state: State, options: Options) -> DataFrame:
    """Claims of virtual attributes made of known values inside long ones."""
    rows = state.claims.filter(~T.is_virtual(F.col("name"))).withColumn("node", node())
    n = nodes(state.claims, options)
    head = G.atomic(state.clusters, n).filter("atomic").select("node")
    source = state.clusters.join(head, "node", "left_semi").select("cid").distinct() if options.dictionary_from == "HEAD_CLUSTERS" else None
    known = cut(G.dictionary(state.clusters, rows, options.value_min, options.value_max, options.dictionary_least, options.dictionary_rarity, source))
    own = rows.join(state.clusters, "node", "left").withColumnRenamed("cid", "own")
    # Isolated attributes are always tagged, those of clusters all or of the tail.
    long = own if options.to_tag == "ALL_ATTRIBUTES" else own.join(head, "node", "left_anti")
    if options.every_combination:
        tags = G.tag_all(long.select("value", "own"), known, options.max_ngram, options.min_ngram)
    else:
        tags = G.tag_longest(long.select("value", "own"), known, options.max_ngram, options.min_ngram)
    virtual = cut(G.virtual_claims(long, cut(tags), options.one_cluster))
    return cut(G.filter_virtual(virtual, rows, known, options.virtual_ratio, options.virtual_least, options.virtual_score))


def significant_tokens(state: State, options: Options) -> DataFrame:
    """Claims of virtual attributes of the tokens that tell of each other inside a cluster."""
    rows = state.claims.filter(~T.is_virtual(F.col("name"))).withColumn("node", node())
    held = rows.join(state.clusters, "node").select("cid", *SA).distinct()
    sets = rows.withColumn("value", F.split("value", " ")).join(state.linkage, C.PAGE)
    mi = M.mutual_information(held, sets, least_pages=options.mi_pages).filter((F.col("mi") >= options.min_mi) & (F.col("kept") >= options.mi_pairs))
    chosen = M.token_clusters(mi, held, options.mi_tokens)
    own = rows.join(held, SA).join(chosen, "cid").withColumn("hit", F.array_sort(F.array_intersect(F.array_distinct(F.split("value", " ")), "tokens")))
    made = own.filter("size(hit) > 0").select("site", "category", "url", F.concat("name", F.lit(f"{T.SEPARATOR}mi_"), F.col("cid").cast("string")).alias("name"), F.array_join("hit", " ").alias("value"))
    least = made.groupBy(*SA).agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= options.mi_values)
    return cut(made.join(least, SA, "left_semi"))


def original_pairs(state: State) -> DataFrame:
    """Pairs of original attributes in one cluster: what the stop test looks at."""
    real = state.claims.filter(~T.is_virtual(F.col("name"))).select(node().alias("node")).distinct()
    return K.cluster_pairs(state.clusters.join(real, "node", "left_semi"))


def tag_loop(state: State, options: Options, mi: bool = False, scorer: K.Scorer | None = None) -> State:
    """Rounds of matching and tagging until the clusters of original attributes stay; fails if they don't within options.rounds."""
    base, before = state.claims, None
    for k in range(options.rounds):
        state.rounds = k + 1
        state = align(state, options, scorer)
        now = cut(original_pairs(state))
        if before is not None and not now.exceptAll(before).limit(1).count() and not before.exceptAll(now).limit(1).count():
            return state
        before = now
        fresh = (significant_tokens if mi else tag)(state, options)
        state.claims = cut(base.unionByName(fresh))
    raise NotConverged(f"the clusters still changed after {options.rounds} rounds")


def clear(state: State) -> State:
    """The state without virtual attributes that add nothing."""
    n = state.claims.select(*SA).distinct().select(node().alias("node"), F.concat_ws("//", "category", "site", T.original_name(F.col("name"))).alias("orig"))
    state.clusters = cut(G.clear_output(state.clusters, n, state.claims.select(node().alias("node"), "url")))
    return state


def _classic(s: State, o: Options, scorer=None) -> State:
    return align(s, o, scorer)


def _classic_name(s: State, o: Options) -> State:
    s = _classic(s, o)
    s.clusters = group_names(s, o)
    return s


def _name_group(s: State, o: Options) -> State:
    s = _classic(s, o)
    names = s.claims.select(node().alias("node"), "name", "category").distinct()
    held = K.clique_edges(s.clusters, "cid", "node", 2.0).unionByName(K.frequent_name_edges(s.clusters, names))
    n = nodes(s.claims, o)
    found = K.cluster(held.groupBy("n1", "n2").agg(F.max("weight").alias("weight")), n, "free")
    s.clusters = cut(K.with_master(found, n, o.min_external) if o.masters else found)
    return s


def _name_baseline(s: State, o: Options, frequent: bool = False) -> State:
    s.clusters = cut(K.cluster(K.by_name(s.claims, frequent), nodes(s.claims, o), o.rule))
    return s


def _domain_edges(s: State, o: Options) -> DataFrame:
    a, b = (F.concat_ws("//", "category", f"site{k}", f"name{k}") for k in (1, 2))
    rows = transformed(s, o)
    return M.domain_similarity(rows, most_share=o.domain_share).select(F.least(a, b).alias("n1"), F.greatest(a, b).alias("n2"), F.round("similarity", 12).alias("weight"))


def _domain_baseline(s: State, o: Options) -> State:
    s.clusters = cut(K.cluster(_domain_edges(s, o), nodes(s.claims, o), "same_page"))
    return s


def _mixed_baseline(s: State, o: Options) -> State:
    s = _name_baseline(s, o)
    s.clusters = cut(K.aggregate(s.clusters, _domain_edges(s, o), nodes(s.claims, o), "same_page", 0.9))
    return s


def _tag(s: State, o: Options, names: str | None, mi: bool = False, scorer=None) -> State:
    s = tag_loop(s, o.but(names=names or "NONE"), mi, scorer)
    if names:
        s.clusters = group_names(s, o.but(names=names))
    return clear(s)


def _tag_updown(s: State, o: Options, names: str | None) -> State:
    """The tag loop, and again with the behaviour of record linkage turned from adding to deleting or back."""
    s = tag_loop(s, o)
    s.claims = cut(s.claims.filter(~T.is_virtual(F.col("name"))))
    return _tag(s, o.but(linkage_behavior={"ADD": "DELETE", "DELETE": "ADD"}.get(o.linkage_behavior, o.linkage_behavior)), names)


MODES = {
    "classic": _classic,
    "comapp": _classic,
    "classic-name": _classic_name,
    "namebl": _name_baseline,
    "domainbl": _domain_baseline,
    "mixbl": _mixed_baseline,
    "namegroup": _name_group,
    "tag-n0": lambda s, o: _tag(s, o, None),
    "tag-p": lambda s, o: _tag(s, o, "SAME_PAGE"),
    "tag-c": lambda s, o, scorer=None: _tag(s, o, "SAME_PAGE", scorer=scorer),
    "mi-n0": lambda s, o: _tag(s, o, None, mi=True),
    "mi": lambda s, o: _tag(s, o, "FULL", mi=True),
    "tag": lambda s, o: _tag(s, o, "FULL"),
    "tag-x": lambda s, o: _tag(s, o, "EXCLUDE_SPLIT"),
    "tag-b": lambda s, o: _tag(s, o, "BLACKLIST_SPLIT"),
    "tag-xp": lambda s, o: _tag(s, o, "SAME_PAGE_EXCLUDE_SPLIT"),
    "tag-ud": lambda s, o: _tag_updown(s, o, "FULL"),
    "tag-ud0": lambda s, o: _tag_updown(s, o, None),
}


def run(mode: str, claims: DataFrame, linkage: DataFrame, options: Options | None = None, **more: object) -> State:
    """A run of a mode, `tag-p` or, with its greatest number of rounds, `tag-p--7`. comapp and tag-c need scorer=."""
    name, _, number = mode.partition("--")
    options = options or Options()
    if number:
        # Of mixbl the number is the greatest share of attributes that a value of its domains may be in, in hundredths.
        options = options.but(domain_share=int(number) / 100) if name == "mixbl" else options.but(rounds=int(number))
    if name in ("comapp", "tag-c") and "scorer" not in more:
        raise ValueError(f"{name} needs an external matcher: scorer=")
    return restored(MODES[name](prepare(claims, linkage, options), options, **more))
