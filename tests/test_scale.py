"""The cost of operators over tables in which many rows are alike."""

from pyspark.sql import functions as F

from attrweave.operators import claims as C
from attrweave.operators import clustering as K
from attrweave.operators import evaluation as E
from attrweave.operators import linkage as L
from attrweave.operators import matching as M
from attrweave.operators import stats as A
from attrweave.operators import tables as X
from attrweave.operators import tagging as G
from attrweave.plans import tables as B
from tests.measures import cost


def test_metablocking_shuffles_no_pairs_of_items(spark):
    rows = spark.range(600).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("b"), F.lit(2).cast("long").alias("s"))
    rows = rows.filter("i <> 7 or b = 1")
    found = []
    spent = cost(spark, lambda: found.extend(M.blocked_pairs(rows, "g", "i", "b", "s", 4).collect()))
    assert len(found) == 300 * 299 and {r.score for r in found} == {6} and 7 not in {r.i2 for r in found}
    assert spent["shuffled"] < 20_000, spent


def test_page_candidates_shuffle_no_pairs_of_pages(spark):
    rows = spark.range(600).select(F.lit("c").alias("category"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("site"), F.col("id").cast("string").alias("url"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("block"), F.lit(100).alias("score"))
    alone = rows.limit(0).unionByName(spark.createDataFrame([("c", "b", "601", "x", 100), ("c", "b", "601", "only", 100), ("c", "b", "602", "y", 100), ("c", "b", "602", "y", 100)], rows.schema))
    found = []
    spent = cost(spark, lambda: found.extend(L.page_candidates(rows.unionByName(alone), 160).collect()))
    assert len(found) == 300 * 300 + 300 and {r.score for r in found} == {200} and {r.url2 for r in found if not int(r.url2) % 2} == {"602"}
    assert spent["shuffled"] < 20_000, spent


def test_contained_sets_meet_no_pairs_of_keys(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e"))
    odd = spark.createDataFrame([(1000, 1), (1000, 2), (1001, 1), (1001, None), (1002, 4), (1003, None), (1004, 4), (1004, None)], "k long, e int")
    found = []
    spent = cost(spark, lambda: found.extend(r.k for r in C.contained_sets(rows.unionByName(odd), "k", "e").collect()))
    # Of equal sets the greatest key stays; a null is in no other set, but makes a set larger.
    assert sorted(found) == [*range(499), 1000, 1002]
    assert spent["shuffled"] < 12_000, spent


def test_nodes_apart_are_compared_by_classes_in_several_tasks(spark):
    nodes = spark.range(600).select(F.col("id").alias("node"), F.lit("n").alias("name"), F.array(F.lit("v"), (F.col("id") % 8).cast("string")).alias("top"))
    clustered = spark.range(600).select((F.col("id") % 8).alias("cid"), F.col("id").alias("node"))
    found = X.apart_by_name(clustered, nodes).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 600 * 599 // 2 - 8 * 75 * 74 // 2
    assert all(r.n1 < r.n2 and (r.n1 - r.n2) % 8 and r.common == ["v"] and r.only1 == [str(r.n1 % 8)] and r.only2 == [str(r.n2 % 8)] for r in found)
    assert len({r.task for r in found}) > 1  # not all the pairs of a name in one task


def test_small_components_share_a_task(spark):
    edges = spark.range(500).select(F.col("id"), F.explode(F.array(F.lit("b"), F.lit("c"))).alias("k")).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("n1"), F.concat("k", F.col("id").cast("string")).alias("n2"), (F.col("id") + F.when(F.col("k") == "b", 0.5).otherwise(0.0)).alias("weight"))
    nodes = edges.select(F.col("n2").alias("node"), F.lit("s").alias("source"), F.lit(False).alias("master"), F.array(F.lit("p")).alias("urls"))
    df = K.cluster(edges, nodes, "source")
    found = {r.node: r.cid for r in df.collect()}
    assert len(found) == 1_000 and all(found[f"a{k}"] == found[f"b{k}"] == 499 - k and f"c{k}" not in found for k in range(500))
    assert "FlatMapCoGroups" not in df._jdf.queryExecution().toString()  # a call, with tables of its own, for each component


def test_pairs_are_counted_from_groups(spark):
    """A group of 600 has 179,700 pairs; two nodes share two groups of the first clustering."""
    first = spark.range(600).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cid"))
    first = first.unionByName(spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, None), (None, 7), (900, 8), (901, 8)], "node long, cid long"))
    second = spark.range(602).select(F.col("id").alias("node"), (F.col("id") % 2).alias("cid"))
    found = []
    spent = cost(spark, lambda: found.extend(E.schema_level(first, second).collect()))
    assert tuple(found[0])[:3] == (2 * 300 * 299 // 2, 600 * 599 // 2, 2 * 300 * 299 // 2)
    assert spent["shuffled"] < 20_000, spent


def test_union_of_clusterings_counts_pairs_of_both_once(spark):
    first = spark.range(400).select(F.col("id").alias("node"), F.lit(1).alias("cid"))
    second = spark.range(300).select(F.col("id").alias("node"), F.lit("1").alias("cid")).unionByName(spark.createDataFrame([(500, "x"), (501, "x")], "node long, cid string"))
    small = spark.createDataFrame([(0, 3), (1, 3), (500, 4), (501, 4), (600, 5), (601, 5)], "node long, cid int")
    assert tuple(E.union_level(first, second, small).first())[:3] == (2, 400 * 399 // 2 + 1, 3)
    few = [x.filter("node < 3 or node > 390") for x in (first, second)]
    assert tuple(E.union_level(*few, small).first())[:3] == (2, 12 * 11 // 2 + 1, 3)


def test_pairs_apart_come_by_one_exchange_in_several_tasks(spark):
    first = spark.range(300).select(F.col("id").alias("node"), F.lit(0).alias("cid"))
    second = spark.range(301).select(F.col("id").alias("node"), (F.col("id") % 300 == 0).cast("string").alias("cid"))
    found = E.pairs_apart(first, second).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.n1, r.n2, r.only_in) for r in found} == {(0, k, 1) for k in range(1, 300)} | {(0, 300, 2)} and len(found) == 300
    assert len({r.task for r in found}) > 1


def test_linked_tables_meet_their_entities_without_a_join(spark, sf):
    rows = B.linked(spark, sf, ("orders", "lineitem"))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    want = B.claims(spark, sf, ("orders", "lineitem")).join(B.linkage(spark, sf, ("orders", "lineitem")), ["site", "category", "url"])
    keep = ["pid", "site", "category", "url", "name", "value"]
    assert rows.select(*keep).exceptAll(want.select(*keep)).count() == 0 == want.select(*keep).exceptAll(rows.select(*keep)).count()


def test_equal_matches_of_an_entity_are_one_row(spark):
    linked = spark.range(400).select(F.lit("c").alias("category"), F.lit("p").alias("pid"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("site"), F.lit("n").alias("name"), (F.col("id") % 10 > 1).cast("string").alias("value"), F.col("id").cast("string").alias("url"))
    pairs = M.candidates(linked)
    assert [tuple(r) for r in pairs.collect()] == [("c", "a", "n", "b", "n", 2)]
    rows = M.counted_matches(pairs, linked)
    by = ["value1", "value2"]
    want = M.value_matches(pairs, linked).groupBy(*by).agg(F.count("*").alias("m"), F.round(F.sum("w"), 9).alias("w"))
    found = [tuple(r) for r in rows.select(*by, "m", F.round("w", 9)).collect()]
    assert sorted(found) == sorted(tuple(r) for r in want.collect()) and len(found) == 4


def test_linkage_is_gathered_by_entity(spark, sf):
    plan = A.size_buckets(B.linkage(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION_BY") // 10 <= 2, plan  # by entity, and of the counts


def test_entities_of_a_source_are_joined_of_ranges(spark):
    links = spark.range(2_000).select(F.format_string("p%04d", F.col("id") % 1_000).alias("pid"), F.lit("s").alias("site"), F.lit("c").alias("category"), F.col("id").cast("string").alias("url"))
    links = links.unionByName(spark.createDataFrame([(None, "t", "c", "u")], "pid string, site string, category string, url string"))
    found = A.joined_entities(links).collect()
    assert {r.site: r.pids for r in found} == {"s": "|".join(f"p{k:04}" for k in range(1_000)), "t": ""}


def test_counts_of_a_category_expand_no_rows(spark):
    claims = spark.createDataFrame([("s", "c", "u", "n", "v"), ("s", "c", "u", "m", "v"), ("t", "c", "u", "n", None)], "site string, category string, url string, name string, value string")
    links = spark.createDataFrame([("p", "s", "c", "u"), ("p", "s", "c", None), ("q", "s", "d", "u")], "pid string, site string, category string, url string")
    df = A.general(claims, links)
    assert sorted(map(tuple, df.collect())) == [("ALL", 2, 2, 3, 3, 1, 1, 1), ("c", 2, 2, 3, 3, 1, 1, 1)]
    stats = A.source_schema(claims)
    assert sorted(map(tuple, stats.collect()))[0] == ("s", "c", 1, 2, 2.0, 1.0, 2, 2, 2, 2, 1)
    assert "Expand" not in stats._jdf.queryExecution().optimizedPlan().toString()


def test_a_popular_attribute_is_joined_by_several_tasks(spark):
    claims = spark.range(1_200).select(F.lit("s").alias("site"), F.lit("c").alias("category"), F.col("id").cast("string").alias("url"), F.lit("n").alias("name"), (F.col("id") % 600).cast("string").alias("value"), F.lit("c//s//n").alias("node"))
    truth = spark.createDataFrame([("s", "n", "t")], "site string, name string, target string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = []
        spent = cost(spark, lambda: found.extend(X.truth_by_instance(truth, claims).collect()))
        assert len(found) == 1_200 and spent["most"] < 1_000, spent
        clustered = spark.createDataFrame([(1, "c//s//n"), (1, "c//t//n"), (2, "d")], "cid int, node string")
        more = claims.unionByName(claims.withColumn("node", F.lit("c//t//n"))).unionByName(claims.limit(1).withColumns({"node": F.lit("d"), "value": F.lit("x")}))
        found.clear()
        spent = cost(spark, lambda: found.extend(G.dictionary(clustered, more, shortest=1).collect()))
        assert len(found) == 600 and spent["most"] < 1_000, spent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_predictions_meet_triples_by_one_exchange(spark):
    triples = spark.createDataFrame([("p", "n", "x", 2), ("p", "n", "y", 2), ("q", "n", "x", 1)], "pid string, name string, value string, values long")
    guessed = spark.createDataFrame([("p", "n", "x"), ("p", "n", "z"), ("p", "n", "z"), ("q", "m", "x"), ("p", "n", None), (None, "n", "x")], "pid string, name string, value string")
    df = X.link_prediction(triples, guessed)
    assert {r.kind: r.n for r in df.collect()} == {"known": 1, "ambiguous": 3, "inductable": 2}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
