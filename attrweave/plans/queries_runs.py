"""More of the catalogue: clusterings, evaluation, side-by-side tables, linkage and what runs report, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.operators import claims as C
from attrweave.operators import clustering as K
from attrweave.operators import evaluation as E
from attrweave.operators import linkage as L
from attrweave.operators import matching as M
from attrweave.operators import stats as A
from attrweave.operators import tables as X
from attrweave.operators import tagging as G
from attrweave.plans import tables as B
from attrweave.plans.queries import _PARTS, _parts, _tagging, query
from attrweave.sources import readers as R
from attrweave.sources import writers as W


def _sig(x: str) -> str:
    unit = f"pow(10, 2 - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} <= 0 THEN {x} ELSE round({x} * {unit}) / {unit} END"


def _metrics(counts: str, keep: str = "") -> str:
    """tp, computed, expected with p, r, f of three digits."""
    inner = f"SELECT *, CASE WHEN computed = 0 THEN -1.0::DOUBLE ELSE tp / computed END AS p_, CASE WHEN expected = 0 THEN -1.0::DOUBLE ELSE tp / expected END AS r_ FROM ({counts})"
    middle = f"SELECT *, CASE WHEN p_ < 0 OR r_ < 0 THEN -1.0::DOUBLE WHEN p_ + r_ = 0 THEN 0.0::DOUBLE ELSE 2 * p_ * r_ / (p_ + r_) END AS f_ FROM ({inner})"
    return f"SELECT {keep}tp, computed, expected, {_sig('p_')} AS p, {_sig('r_')} AS r, {_sig('f_')} AS f FROM ({middle})"


def _pairs(table: str) -> str:
    return f"SELECT DISTINCT x.node AS n1, y.node AS n2 FROM {table} x JOIN {table} y USING (cid) WHERE x.node < y.node"


_COUNTS = "SELECT (SELECT count(*) FROM p SEMI JOIN q USING (n1, n2)) AS tp, (SELECT count(*) FROM p) AS computed, (SELECT count(*) FROM q) AS expected"


# Evaluation


@query(f"WITH k AS (SELECT o_custkey % 200 AS cid, o_orderpriority AS real FROM orders), c AS (SELECT cid, real, count(*) AS n FROM k GROUP BY ALL) {_metrics('SELECT (SELECT sum(n * (n - 1) / 2) FROM c)::BIGINT AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY cid))::BIGINT AS computed, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY real))::BIGINT AS expected')}")
def cluster_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 200).alias("cid"), F.col("o_orderpriority").alias("real"))
    return E.by_cells(k, "node", "cid", "real").select("tp", "computed", "expected", "p", "r", "f")


_LINES = "a AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS cid FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS node, l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS cid FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = B.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("cid")).distinct(), li.select(F.col("l_orderkey").alias("node"), (F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("cid")).distinct()


@query(f"WITH {_LINES}, p AS ({_pairs('a')}), q AS ({_pairs('b')}) {_metrics(_COUNTS)}")
def schema_level_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.schema_level(*_lines(spark, sf)).select("tp", "computed", "expected", "p", "r", "f")


@query(f"WITH {_LINES}, o AS (SELECT o_orderkey AS node, o_custkey AS cid FROM orders), p AS ({_pairs('b')} UNION {_pairs('o')}), q AS ({_pairs('a')}) {_metrics(_COUNTS)}")
def union_of_clusterings(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lines(spark, sf)
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("cid"))
    return E.union_level(b, o, a).select("tp", "computed", "expected", "p", "r", "f")


_ORDERS = "a AS (SELECT o_orderkey AS node, o_custkey AS cid FROM orders), b AS (SELECT o_orderkey AS node, CAST(o_custkey AS VARCHAR) || o_orderstatus AS cid FROM orders)"


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = B.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("cid")), o.select(F.col("o_orderkey").alias("node"), F.concat(F.col("o_custkey").cast("string"), "o_orderstatus").alias("cid"))


@query(f"WITH {_ORDERS}, p AS ({_pairs('a')}), q AS ({_pairs('b')}) SELECT n1, n2, 1 AS only_in FROM p ANTI JOIN q USING (n1, n2) UNION ALL SELECT n1, n2, 2 FROM q ANTI JOIN p USING (n1, n2)")
def pairs_of_one_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return E.pairs_apart(*_orders(spark, sf))


@query(f"""
WITH {_ORDERS}, t AS (SELECT o_orderkey AS node, o_orderpriority AS part FROM orders),
x AS (SELECT a.node, cid, part FROM a JOIN t USING (node)), y AS (SELECT b.node, cid, part FROM b JOIN t USING (node)),
p AS (SELECT u.node AS n1, v.node AS n2, part FROM x u JOIN x v USING (cid, part) WHERE u.node < v.node), q AS (SELECT u.node AS n1, v.node AS n2, part FROM y u JOIN y v USING (cid, part) WHERE u.node < v.node),
m AS (SELECT part, count(CASE WHEN p.n1 IS NOT NULL AND q.n1 IS NOT NULL THEN 1 END) AS tp, count(p.n1) AS computed, count(q.n1) AS expected FROM p FULL JOIN q USING (n1, n2, part) GROUP BY part)
{_metrics('SELECT * FROM m', 'part, ')}
""")
def scores_by_part(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _orders(spark, sf)
    parts = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("part"))
    return E.partitioned(a, b, parts).select("part", "tp", "computed", "expected", "p", "r", "f")


@query(f"""
WITH a AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node, l_orderkey AS cid FROM lineitem), b AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node, l_orderkey || l_returnflag AS cid FROM lineitem),
p AS ({_pairs('a')}), q AS ({_pairs('b')}) {_metrics(_COUNTS)}
""")
def instance_level_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    rows = li.select(F.lit("lineitem").alias("site"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("url"), F.lit("l_partkey").alias("name"), F.col("l_orderkey").cast("string").alias("order"), "l_returnflag")
    found, truth = rows.select("site", "url", "name", F.col("order").alias("target")), rows.select("site", "url", "name", F.concat("order", "l_returnflag").alias("target"))
    return E.instance_level(found, truth).select("tp", "computed", "expected", "p", "r", "f")


@query(f"""
WITH n AS (SELECT c_nationkey AS target, c_mktsegment AS found FROM customer), m AS (SELECT target, found, count(*) AS tp FROM n GROUP BY ALL),
s AS (SELECT m.*, e.expected, c.computed FROM m JOIN (SELECT target, count(*) AS expected FROM n GROUP BY 1) e USING (target) JOIN (SELECT found, count(*) AS computed FROM n GROUP BY 1) c USING (found)),
z AS ({_metrics('SELECT * FROM s', 'target, found, ')})
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f DESC, found) AS k FROM z) WHERE k = 1
""")
def best_targets(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    return E.best_targets(c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("cid")), c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("cid")))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS node, o_orderpriority AS cid FROM orders), b AS (SELECT DISTINCT o_custkey AS node, o_orderstatus AS real FROM orders),
m AS (SELECT cid, real, count(*) AS n FROM a JOIN b USING (node) GROUP BY ALL), x AS (SELECT * FROM a JOIN b USING (node) JOIN m USING (cid, real)),
r AS (SELECT *, row_number() OVER (PARTITION BY node, cid ORDER BY n DESC, real) AS i, row_number() OVER (PARTITION BY node, real ORDER BY n DESC, cid) AS j FROM x), p AS (SELECT node, cid, real FROM r WHERE i = 1 AND j = 1)
SELECT * FROM p UNION ALL SELECT node, cid, NULL FROM a ANTI JOIN p USING (node, cid) UNION ALL SELECT node, NULL, real FROM b ANTI JOIN p USING (node, real)
""")
def truth_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return E.comparison_rows(o.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("cid")).distinct(), o.select(F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("cid")).distinct())


@query(f"""
WITH s AS (SELECT DISTINCT o_orderstatus AS site FROM orders), o AS (SELECT site, row_number() OVER (ORDER BY site) AS place FROM s),
a AS (SELECT o_orderkey AS node, o_custkey AS cid, place FROM orders JOIN o ON site = o_orderstatus), b AS (SELECT node, cid || o_orderpriority AS cid, place FROM a JOIN orders ON o_orderkey = node),
p AS (SELECT x.node AS n1, y.node AS n2, greatest(x.place, y.place) AS place FROM a x JOIN a y USING (cid) WHERE x.node < y.node), q AS (SELECT x.node AS n1, y.node AS n2, greatest(x.place, y.place) AS place FROM b x JOIN b y USING (cid) WHERE x.node < y.node),
m AS (SELECT place, count(CASE WHEN p.n1 IS NOT NULL AND q.n1 IS NOT NULL THEN 1 END) AS tp, count(p.n1) AS computed, count(q.n1) AS expected FROM p FULL JOIN q USING (n1, n2, place) GROUP BY place),
u AS (SELECT place, sum(coalesce(tp, 0)) OVER w::BIGINT AS tp, sum(coalesce(computed, 0)) OVER w::BIGINT AS computed, sum(coalesce(expected, 0)) OVER w::BIGINT AS expected FROM o LEFT JOIN m USING (place) WINDOW w AS (ORDER BY place ROWS UNBOUNDED PRECEDING))
{_metrics('SELECT * FROM u', 'place, ')}
""".replace("OVER w::BIGINT", "OVER w"))
def source_by_source(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = B.table(spark, sf, "orders")
    order = o.select(F.col("o_orderstatus").alias("site")).distinct().withColumn("place", F.row_number().over(Window.orderBy("site")).cast("long"))  # a row for each status
    found = o.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").cast("string").alias("cid"), F.col("o_orderstatus").alias("site"))
    truth = o.select(F.col("o_orderkey").alias("node"), F.concat(F.col("o_custkey").cast("string"), "o_orderpriority").alias("cid"), F.col("o_orderstatus").alias("site"))
    return E.prefixes(found, truth, order).select("place", "tp", "computed", "expected", "p", "r", "f")


@query("""
WITH c AS (SELECT p_brand AS target, p_type AS name, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT name, target, row_number() OVER (PARTITION BY target ORDER BY n DESC, name) AS place FROM c), f AS (SELECT * FROM k WHERE place <= 3), t AS (SELECT DISTINCT p_type AS name, p_brand AS target FROM part WHERE p_size > 25),
h AS (SELECT place, CASE WHEN t.name IS NOT NULL THEN 1 ELSE 0 END AS ok, CASE WHEN row_number() OVER (PARTITION BY f.target ORDER BY place, f.name) > 1 THEN 1 ELSE 0 END AS again FROM f LEFT JOIN t ON t.name = f.name AND t.target = f.target),
g AS (SELECT place, sum(ok) AS tp, sum(1 - ok) AS fp, sum(again) AS duplicated FROM h GROUP BY place), u AS (SELECT place, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(duplicated) OVER w AS duplicated FROM g WINDOW w AS (ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT *, (SELECT count(*) FROM t) - tp AS fn FROM u
""")
def ontology_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = B.table(spark, sf, "part")
    found = p.groupBy(F.col("p_brand").alias("target"), F.col("p_type").alias("name")).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "name"))).select("name", "target", "place")
    return X.ontology(found, p.filter("p_size > 25").select(F.col("p_type").alias("name"), F.col("p_brand").alias("target")).distinct())


_TRIPLES = "SELECT *, count(*) OVER (PARTITION BY pid, name) AS values FROM (SELECT DISTINCT pid, name, value FROM linked)"


@query(_TRIPLES)
def link_triples(spark: SparkSession, sf: str) -> DataFrame:
    return X.triples(B.linked(spark, sf))


@query(f"""
WITH t AS ({_TRIPLES}), g AS (SELECT 'trade-' || CAST(o_orderkey AS VARCHAR) AS pid, unnest(['o_orderstatus', 'o_orderpriority', 'o_clerk']) AS name, 'F' AS value FROM orders),
v AS (SELECT pid, name, max(values) AS values FROM t GROUP BY ALL)
SELECT CASE WHEN t.pid IS NOT NULL THEN 'known' WHEN v.pid IS NULL THEN 'inductable' ELSE 'ambiguous' END AS kind, count(*) AS n FROM g LEFT JOIN t USING (pid, name, value) LEFT JOIN v ON v.pid = g.pid AND v.name = g.name GROUP BY 1
""")
def link_prediction_kinds(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    guessed = o.select(F.concat(F.lit("trade-"), F.col("o_orderkey").cast("string")).alias("pid"), F.explode(F.array(*map(F.lit, ("o_orderstatus", "o_orderpriority", "o_clerk")))).alias("name"), F.lit("F").alias("value"))
    return X.link_prediction(X.triples(B.linked(spark, sf)), guessed)


@query("""
WITH d AS (SELECT category, site, name, value, count(*) AS o FROM claims WHERE category = 'trade' GROUP BY ALL), p AS (SELECT DISTINCT category, a.site AS site1, a.name AS name1, b.site AS site2, b.name AS name2 FROM d a JOIN d b USING (category, value) WHERE a.site < b.site),
x AS (SELECT p.*, value, o FROM p JOIN d ON d.site = site1 AND d.name = name1), y AS (SELECT p.*, value, o FROM p JOIN d ON d.site = site2 AND d.name = name2)
SELECT * FROM (SELECT category, site1, name1, site2, name2, round(sum(least(coalesce(x.o, 0), coalesce(y.o, 0))) / sum(greatest(coalesce(x.o, 0), coalesce(y.o, 0))), 6) AS similarity
FROM x FULL JOIN y USING (category, site1, name1, site2, name2, value) GROUP BY ALL) WHERE similarity >= 0.001
""")
def golden_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.golden_pairs(C.domains(B.claims(spark, sf)), ["orders", "lineitem"], 0.001).withColumn("similarity", F.round("similarity", 6))


@query("SELECT c_nationkey AS target, count(DISTINCT c_mktsegment) AS names FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def ambiguous_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return E.predicate_names(B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("target"), F.col("c_mktsegment").alias("predicate_name")))


@query("""
WITH s AS (SELECT o_orderstatus AS site, o_custkey AS url, o_orderpriority AS name, string_agg(DISTINCT CAST(o_shippriority AS VARCHAR) || CAST(o_orderkey % 2 AS VARCHAR), ',' ORDER BY CAST(o_shippriority AS VARCHAR) || CAST(o_orderkey % 2 AS VARCHAR)) AS targets FROM orders GROUP BY ALL)
SELECT site, name FROM s GROUP BY ALL HAVING count(DISTINCT targets) > 1
""".replace("CAST(o_shippriority AS VARCHAR) || ", ""))
def heterogeneous_attributes(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return R.heterogeneous(o.select(F.col("o_orderstatus").alias("site"), F.col("o_custkey").alias("url"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 2).cast("string").alias("target")))


# Clusterings

_STARS = "e AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS n1, 'o' || CAST(o_orderkey AS VARCHAR) AS n2, o_totalprice::DOUBLE AS weight, o_orderstatus AS s FROM orders), f AS (SELECT n1, max(struct_pack(w := weight, a := n1, b := n2)) AS t FROM e GROUP BY 1), i AS (SELECT n1, row_number() OVER (ORDER BY t.w DESC, t.a DESC, t.b DESC) - 1 AS cid FROM f)"


def _stars(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as edges of their price, and the nodes; an order's page and source is its status."""
    o = B.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("n1"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("n2"), F.col("o_totalprice").cast("double").alias("weight"), F.col("o_orderstatus").alias("s"))
    none = F.array().cast("array<string>")
    nodes = o.select(F.col("n2").alias("node"), F.col("s").alias("source"), F.lit(False).alias("master"), F.array("s").alias("urls")).unionByName(o.select(F.col("n1").alias("node"), F.lit("customer").alias("source"), F.lit(False).alias("master"), none.alias("urls")).distinct())
    return o.select("n1", "n2", "weight"), nodes


@query(f"WITH {_STARS} SELECT cid, n1 AS node FROM i UNION ALL SELECT cid, n2 FROM e JOIN i USING (n1)")
def free_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return K.cluster(*_stars(spark, sf), "free")


_RULED = f"WITH {_STARS}, r AS (SELECT *, row_number() OVER (PARTITION BY n1, s ORDER BY weight DESC, n2 DESC) AS k FROM e) SELECT cid, n1 AS node FROM i UNION ALL SELECT cid, n2 FROM r JOIN i USING (n1) WHERE k = 1"


@query(_RULED)
def one_of_a_source(spark: SparkSession, sf: str) -> DataFrame:
    # Of a customer's orders each status keeps the dearest: the next ones are refused.
    return K.cluster(*_stars(spark, sf), "source")


@query(_RULED)
def one_of_a_page(spark: SparkSession, sf: str) -> DataFrame:
    return K.cluster(*_stars(spark, sf), "same_page")


@query(f"WITH {_ORDERS}, p AS ({_pairs('a')}), q AS ({_pairs('b')}) SELECT count(CASE WHEN p.n1 IS NOT NULL AND q.n1 IS NOT NULL THEN 1 END) AS kept, count(CASE WHEN p.n1 IS NULL THEN 1 END) AS added, count(CASE WHEN q.n1 IS NULL THEN 1 END) AS deleted FROM p FULL JOIN q USING (n1, n2)")
def clustering_evolution(spark: SparkSession, sf: str) -> DataFrame:
    return K.evolution(*_orders(spark, sf))


@query(f"WITH {_ORDERS}, x AS (SELECT DISTINCT string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS h FROM a GROUP BY cid), y AS (SELECT DISTINCT string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS h FROM b GROUP BY cid) SELECT round((SELECT count(*) FROM x SEMI JOIN y USING (h)) / (SELECT count(*) FROM (SELECT h FROM x UNION SELECT h FROM y)), 6) AS same")
def same_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(round(K.same_clusters(*_orders(spark, sf)), 6),)], "same double")


@query(f"WITH {_ORDERS}, m AS (SELECT a.cid AS c, max(n) AS n FROM a JOIN (SELECT o_custkey AS cid, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) t ON t.cid = a.cid GROUP BY 1) SELECT round(sum(n) / (SELECT count(*) FROM a), 6) AS overlap FROM m")
def paired_overlap(spark: SparkSession, sf: str) -> DataFrame:
    # Each customer's orders are cut by status, so that the best pairing takes the largest part of each.
    return spark.createDataFrame([(round(K.paired_overlap(*_orders(spark, sf)), 6),)], "overlap double")


@query("""
WITH n AS (SELECT o_custkey AS cid, o_orderpriority AS name, count(*) AS c FROM orders GROUP BY ALL)
SELECT cid, name AS label FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY c DESC, name) AS k FROM n) WHERE k = 1
""")
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return K.name_of(o.select(F.col("o_custkey").alias("cid"), F.col("o_orderkey").alias("node")), o.select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("name")))


@query("""
WITH k AS (SELECT o_custkey AS cid, o_orderkey AS node, o_orderstatus = 'P' AS master FROM orders)
SELECT cid, node FROM k SEMI JOIN (SELECT cid FROM k GROUP BY cid HAVING bool_or(master) OR count(*) >= 12) USING (cid)
""")
def clusters_with_a_master(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return K.with_master(o.select(F.col("o_custkey").alias("cid"), F.col("o_orderkey").alias("node")), o.select(F.col("o_orderkey").alias("node"), (F.col("o_orderstatus") == "P").alias("master")), 12)


@query("SELECT DISTINCT least(a.o_orderkey, b.o_orderkey) AS n1, greatest(a.o_orderkey, b.o_orderkey) AS n2, 2.0::DOUBLE AS weight FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus < b.o_orderstatus")
def edges_across(spark: SparkSession, sf: str) -> DataFrame:
    return K.bipartite_edges(B.table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", 2.0)


@query("""
WITH k AS (SELECT category || '//' || site || '//' || name AS node, category, name, site FROM (SELECT DISTINCT category, name, site FROM claims)), n AS (SELECT *, regexp_replace(name, '^[a-z]+_', '') AS label FROM k),
g AS (SELECT DISTINCT category || '//' || label AS g, node FROM n), a AS (SELECT x.node AS n1, y.node AS n2, 2.0::DOUBLE AS w FROM g x JOIN g y USING (g) WHERE x.node < y.node),
c AS (SELECT *, regexp_replace(name, '^[a-z]+_', '') AS label FROM claims), s AS (SELECT category, value FROM c GROUP BY ALL HAVING count(DISTINCT (site, label)) <= 7), z AS (SELECT category, site, label, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT category, site, label, value, count(*) AS c FROM c GROUP BY ALL), r AS (SELECT o.* FROM o JOIN z USING (category, site, label) SEMI JOIN s USING (category, value) WHERE o.c > 7 OR o.c > 0.5 * z.n),
h AS (SELECT DISTINCT category, value, category || '//' || site || '//' || label AS node FROM r), b AS (SELECT x.node AS n1, y.node AS n2, 1.0::DOUBLE AS w FROM h x JOIN h y USING (category, value) WHERE x.node < y.node),
l AS (SELECT DISTINCT category || '//' || label AS g, category || '//' || site || '//' || label AS node FROM c), d AS (SELECT x.node AS n1, y.node AS n2, 2.0::DOUBLE AS w FROM l x JOIN l y USING (g) WHERE x.node < y.node)
SELECT n1, n2, max(w) AS weight FROM (SELECT * FROM b UNION ALL SELECT * FROM d) GROUP BY n1, n2
""")
def name_edges(spark: SparkSession, sf: str) -> DataFrame:
    # Prefixes of columns go, so that the sources have names in common.
    return K.by_name(B.claims(spark, sf).withColumn("name", F.regexp_replace("name", "^[a-z]+_", "")), frequent=True)


@query("""
WITH t AS (SELECT o_custkey AS cid, o_orderpriority AS token FROM orders), s AS (SELECT cid, list_sort(list_distinct(list(token))) AS tokens FROM t GROUP BY cid HAVING count(DISTINCT token) >= 3), n AS (SELECT o_custkey AS cid, count(DISTINCT o_orderstatus) AS sources FROM orders GROUP BY 1)
SELECT cid, array_to_string(tokens, '|') AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY tokens ORDER BY sources DESC, cid) AS k FROM s JOIN n USING (cid)) WHERE k = 1
""")
def token_clusters(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    found = M.token_clusters(o.select(F.col("o_custkey").alias("cid"), F.col("o_orderpriority").alias("token")), o.select(F.col("o_custkey").alias("cid"), F.col("o_orderstatus").alias("site"), F.lit("c").alias("category"), F.lit("n").alias("name")))
    return found.withColumn("tokens", F.array_join("tokens", "|"))


@query("""
WITH m AS (SELECT a.value AS v1, b.value AS v2 FROM linked a JOIN linked b USING (category, pid) WHERE a.site = 'lineitem' AND a.name = 'l_linestatus' AND b.site = 'orders' AND b.name = 'o_orderstatus'),
t AS (SELECT v1 AS token FROM m UNION SELECT v2 FROM m), n AS (SELECT count(*)::DOUBLE AS n FROM m),
c AS (SELECT token, sum((v1 = token)::INT)::DOUBLE AS m1, sum((v2 = token)::INT)::DOUBLE AS m2, sum((v1 = token AND v2 = token)::INT)::DOUBLE AS c11 FROM m CROSS JOIN t GROUP BY token),
e AS (SELECT *, m1 - c11 AS c10, m2 - c11 AS c01, n - m1 - m2 + c11 AS c00 FROM c CROSS JOIN n)
SELECT 1 AS cid, token, round((CASE WHEN c11 > 0 THEN c11 * ln(n * c11 / (m1 * m2)) ELSE 0 END + CASE WHEN c10 > 0 AND n > m2 THEN c10 * ln(n * c10 / (n - m2)) ELSE 0 END
 + CASE WHEN c01 > 0 THEN c01 * ln(n * c01 / ((n - m1) * m2)) ELSE 0 END + CASE WHEN c00 > 0 AND n > m2 THEN c00 * ln(n * c00 / (n - m2)) ELSE 0 END) / n, 6) AS mi, CAST(c11 AS BIGINT) AS both FROM e
""")
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.linked(spark, sf, ("orders", "lineitem")).withColumn("value", F.array("value"))
    held = rows.filter("name in ('l_linestatus', 'o_orderstatus')").select(F.lit(1).alias("cid"), *C.SA).distinct()
    return M.mutual_information(held, rows).select("cid", "token", F.round("mi", 6).alias("mi"), "both")


# Side by side, linkage and reports


@query("""
WITH t AS (SELECT p_partkey AS node, p_name || p_brand AS name, [p_type, CAST(p_size AS VARCHAR)] AS top, p_size AS cid FROM part)
SELECT a.name, a.node AS n1, b.node AS n2, array_to_string(list_filter(a.top, lambda x: list_contains(b.top, x)), '|') AS common, array_to_string(list_filter(a.top, lambda x: NOT list_contains(b.top, x)), '|') AS only1, array_to_string(list_filter(b.top, lambda x: NOT list_contains(a.top, x)), '|') AS only2
FROM t a JOIN t b USING (name) WHERE a.node < b.node AND a.cid <> b.cid
""")
def apart_by_name(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    found = X.apart_by_name(p.select(F.col("p_size").alias("cid"), F.col("p_partkey").alias("node")), p.select(F.col("p_partkey").alias("node"), F.concat("p_name", "p_brand").alias("name"), F.array("p_type", F.col("p_size").cast("string")).alias("top")))
    return found.withColumns({c: F.array_join(c, "|") for c in ("common", "only1", "only2")})


@query("SELECT CAST(coalesce(n.n_nationkey, s.k) AS VARCHAR) AS k, coalesce(n.n_name, s.name) AS name, CAST(n AS VARCHAR) AS n FROM nation n FULL JOIN (SELECT s_nationkey * 2 AS k, min(s_name) AS name, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey")
def merged_tables(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"))
    s = B.table(spark, sf, "supplier").groupBy((F.col("s_nationkey") * 2).cast("string").alias("k")).agg(F.min("s_name").alias("name"), F.count("*").alias("n"))
    return X.merged(n, s, "k")


@query("SELECT pid, site, category, url FROM linkage SEMI JOIN (SELECT DISTINCT pid, url FROM linkage WHERE site IN ('nation', 'customer', 'orders')) USING (pid, url)")
def both_linkages(spark: SparkSession, sf: str) -> DataFrame:
    return X.both_linkages(B.linkage(spark, sf), B.linkage(spark, sf, ("nation", "customer", "orders")))


@query("SELECT DISTINCT site, url, name, regexp_replace(name, '^[a-z]+_', '') AS target FROM claims WHERE name LIKE '%key'")
def truth_by_instance(spark: SparkSession, sf: str) -> DataFrame:
    c = B.claims(spark, sf)
    return X.truth_by_instance(c.filter("name like '%key'").select("site", "name", F.regexp_replace("name", "^[a-z]+_", "").alias("target")).distinct(), c)


@query("""
WITH s AS (SELECT DISTINCT t FROM (SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS t FROM orders GROUP BY o_custkey)), e AS (SELECT t, unnest(string_split(t, '|')) AS x FROM s)
SELECT DISTINCT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b FROM e a JOIN e b USING (x) WHERE a.t < b.t
""")
def targets_that_meet(spark: SparkSession, sf: str) -> DataFrame:
    found = X.targets_that_meet(B.table(spark, sf, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("target")))
    a, b = F.array_join("a", "|"), F.array_join("b", "|")
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


@query("""
WITH p AS (SELECT DISTINCT pid FROM linkage WHERE category = 'geo'), v AS (SELECT pid, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (name = 'n_name') AS n, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (name = 'c_mktsegment') AS c FROM linked WHERE category = 'geo' GROUP BY pid)
SELECT pid, coalesce(n, 'NULL') AS "nation/n_name", coalesce(c, 'NULL') AS "customer/c_mktsegment" FROM p LEFT JOIN v USING (pid)
""")
def alignment_table(spark: SparkSession, sf: str) -> DataFrame:
    geo = ("nation", "supplier", "customer")
    return X.alignment(B.claims(spark, sf, geo), B.linkage(spark, sf, geo), [("nation", "n_name"), ("customer", "c_mktsegment")])


@query("""
WITH c AS (SELECT * FROM claims WHERE site IN ('orders', 'lineitem'))
SELECT value, count(CASE WHEN name = 'o_orderstatus' THEN 1 END) AS "orders/o_orderstatus", count(CASE WHEN name = 'l_linestatus' THEN 1 END) AS "lineitem/l_linestatus" FROM c WHERE name IN ('o_orderstatus', 'l_linestatus') GROUP BY value
UNION ALL SELECT 'NULL', (SELECT count(DISTINCT url) - count(DISTINCT CASE WHEN name = 'o_orderstatus' THEN url END) FROM c WHERE site = 'orders'), (SELECT count(DISTINCT url) - count(DISTINCT CASE WHEN name = 'l_linestatus' THEN url END) FROM c WHERE site = 'lineitem')
""")
def value_table(spark: SparkSession, sf: str) -> DataFrame:
    return X.value_table(B.claims(spark, sf, ("orders", "lineitem")), [("orders", "o_orderstatus"), ("lineitem", "l_linestatus")])


@query(f"""
WITH h AS (SELECT DISTINCT category, site, url, name, lower(array_to_string(regexp_extract_all(value, '[0-9]+[.,]?[0-9]*|[a-zA-Z]+'), ' ')) AS value FROM ({_PARTS})), n AS (SELECT category, site, url, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT a.category, a.site AS site1, a.url AS url1, b.site AS site2, b.url AS url2, count(*) AS shared FROM h a JOIN h b USING (category, name, value) WHERE (a.site, a.url) < (b.site, b.url) GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT s.* FROM s JOIN n x ON x.site = site1 AND x.url = url1 JOIN n y ON y.site = site2 AND y.url = url2 WHERE shared / greatest(x.n, y.n) > 0.9),
w AS (SELECT category, site1 AS site, url1 AS url, site2 AS other FROM k UNION ALL SELECT category, site2, url2, site1 FROM k), g AS (SELECT category, site, count(DISTINCT url) AS pages FROM h GROUP BY ALL)
SELECT category, site, CASE WHEN site = other THEN 'INTERNAL' ELSE other END AS other, count(DISTINCT url) AS copied, round(count(DISTINCT url) / max(pages), 6) AS ratio FROM w JOIN g USING (category, site) GROUP BY 1, 2, 3
""")
def copy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    return A.copy_ratios(A.page_copies(rows), rows)


@query("SELECT site, category, string_agg(DISTINCT pid, '|' ORDER BY pid) AS pids FROM linkage GROUP BY ALL")
def entities_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    return A.joined_entities(B.linkage(spark, sf))


@query("""
WITH m AS (SELECT pid FROM linkage GROUP BY pid HAVING count(DISTINCT url) >= 3), p AS (SELECT DISTINCT site, category, url FROM claims)
SELECT pid, site, category, url FROM linkage SEMI JOIN m USING (pid) SEMI JOIN p USING (site, category, url) WHERE length(pid) BETWEEN 6 AND 9
""")
def linkage_of_many_pages(spark: SparkSession, sf: str) -> DataFrame:
    return C.linked_often(B.linkage(spark, sf), B.claims(spark, sf), 3, 6, 9).select("pid", "site", "category", "url")


@query("""
WITH s AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, url, unnest(['scheme', 'length', 'query']) AS name, unnest([regexp_extract(url, '^([a-z]+)://', 1), CAST(length(html) AS VARCHAR), regexp_extract(url, '\\?(.*)$', 1)]) AS value FROM pages)
SELECT regexp_replace(site, '^www\\.', '') AS site, 'page' AS category, url, name, min(value) AS value FROM s WHERE trim(value) <> '' GROUP BY ALL
""")
def cleaned_claims(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "pages").withColumns({"scheme": F.regexp_extract("url", "^([a-z]+)://", 1), "length": F.length("html"), "query": F.regexp_extract("url", r"\?(.*)$", 1)})
    return C.cleaned(C.from_wide(p, F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit("page"), F.col("url"), ["scheme", "length", "query"]))


@query("""
WITH c AS (SELECT event_type AS site, CAST(user_id AS VARCHAR) AS url, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS name FROM events), z AS (SELECT site, name, count(DISTINCT url) AS n FROM c GROUP BY ALL), g AS (SELECT site, n, sum(n) AS s FROM z GROUP BY ALL),
h AS (SELECT site, n FROM (SELECT site, n, sum(s) OVER (PARTITION BY site ORDER BY n DESC) - s < sum(s) OVER (PARTITION BY site) / 2 AS head FROM g) WHERE head)
SELECT c.site, c.name, count(*) AS claims FROM c JOIN z USING (site, name) JOIN h USING (site, n) GROUP BY ALL
""")
def head_attributes(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("site"), F.lit("e").alias("category"), F.col("user_id").cast("string").alias("url"), F.floor(F.col("value") / 10).cast("string").alias("name"))
    return C.head_attributes(rows).groupBy("site", "name").agg(F.count("*").alias("claims"))


@query("""
WITH i AS (SELECT site, category, url, list_sort(list(DISTINCT pid)) AS ids FROM linkage WHERE site <> 'nation' GROUP BY ALL)
SELECT site, category, name, url, value, ids[1] AS pid, coalesce(len(ids) - 1, 0) AS others FROM claims LEFT JOIN i USING (site, category, url)
""")
def attribute_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.attribute_values(B.claims(spark, sf), B.linkage(spark, sf).filter("site <> 'nation'")).withColumn("others", F.size("others"))


@query("""
WITH r AS (SELECT site, category, value, count(DISTINCT url) AS n FROM claims WHERE category = 'geo' GROUP BY ALL HAVING count(DISTINCT url) <= 30), v AS (SELECT category, value, sum(n) AS n FROM r GROUP BY ALL),
b AS (SELECT DISTINCT c.category, c.site, c.url, 'v' || value AS block, CAST(round(1000 / n) AS INT) AS score FROM claims c JOIN v USING (category, value) UNION ALL SELECT category, site, url, 'p' || pid, 150 FROM linkage WHERE category = 'geo')
SELECT category, a.site AS site1, a.url AS url1, b.site AS site2, b.url AS url2, sum(a.score) AS score FROM b a JOIN b USING (category, block) WHERE a.site < b.site GROUP BY ALL HAVING sum(a.score) >= 160
""")
def page_candidates(spark: SparkSession, sf: str) -> DataFrame:
    geo = ("nation", "supplier", "customer")
    c = B.claims(spark, sf, geo)
    rare = c.groupBy("site", "category", "value").agg(F.countDistinct("url").alias("n")).filter("n <= 30")
    return L.page_candidates(L.blocks(c, rare, B.linkage(spark, sf, geo)), 160)


@query("""
WITH v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS value FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS gram FROM part), t AS (SELECT value, unnest(string_split(value, ' ')) AS gram FROM v)
SELECT value, 4 AS own, length(gram) AS cluster, string_agg(DISTINCT gram, ' ' ORDER BY gram) AS snippet FROM t SEMI JOIN w USING (gram) WHERE length(gram) <> 4 GROUP BY ALL
""")
def virtual_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return G.snippets(G.tag_all(*_tagging(spark, sf), most=1))


@query("""
WITH g AS (SELECT string_split(p_name, ' ') AS w FROM part), d AS (SELECT DISTINCT w[1] || ' ' || w[2] AS gram FROM g), v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS value FROM part), x AS (SELECT value, string_split(value, ' ') AS w FROM v),
p AS (SELECT value, w, unnest(range(1, len(w))) AS i FROM x), b AS (SELECT value, i - 1 AS place, w[i] || ' ' || w[i + 1] AS gram FROM p)
SELECT value, 4 AS own, place, gram, length(gram) AS cluster FROM b SEMI JOIN d USING (gram) WHERE length(gram) <> 4
""")
def tags_of_two_words(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    values = p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("value"), F.lit(4).cast("long").alias("own")).distinct()
    known = p.select(F.concat_ws(" ", F.split("p_name", " ")[0], F.split("p_name", " ")[1]).alias("value")).distinct().select("value", F.array(F.length("value").cast("long")).alias("clusters"))
    return G.tag_all(values, known, most=2, least=2)


@query("""
WITH k AS (SELECT CASE WHEN name LIKE '%nationkey' THEN 1 ELSE 2 END AS cid, site, category, name, value, name LIKE 'c%' AS atomic FROM claims WHERE category = 'geo' AND name IN ('n_nationkey', 's_nationkey', 'c_nationkey', 'c_mktsegment', 'n_regionkey'))
SELECT cid, string_agg(DISTINCT value, '|' ORDER BY value) AS values, coalesce(string_agg(DISTINCT CASE WHEN atomic THEN site || '//' || name END, '|' ORDER BY CASE WHEN atomic THEN site || '//' || name END), '') AS atomic, coalesce(string_agg(DISTINCT CASE WHEN NOT atomic THEN site || '//' || name END, '|' ORDER BY CASE WHEN NOT atomic THEN site || '//' || name END), '') AS non_atomic FROM k GROUP BY cid
""")
def instance_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    c = B.claims(spark, sf, ("nation", "supplier", "customer"))
    held = c.filter("name in ('n_nationkey', 's_nationkey', 'c_nationkey', 'c_mktsegment', 'n_regionkey')").select(F.when(F.col("name").like("%nationkey"), 1).otherwise(2).alias("cid"), *C.SA).distinct()
    found = W.instance_level(held, c, held.select(*C.SA, F.col("name").like("c%").alias("atomic")))
    return found.withColumns({n: F.array_join(n, "|") for n in ("values", "atomic", "non_atomic")})


@query("SELECT DISTINCT regexp_replace(pid, '\\s+', '_', 'g') || chr(9) || regexp_replace(name, '\\s+', '_', 'g') || chr(9) || regexp_replace(value, '\\s+', '_', 'g') AS value FROM linked")
def triple_lines(spark: SparkSession, sf: str) -> DataFrame:
    return W.triples(B.claims(spark, sf), B.linkage(spark, sf))


@query("""
WITH l AS (SELECT * FROM linkage UNION ALL SELECT 'gone-' || CAST(s_suppkey AS VARCHAR), 'supplier', 'geo', 'gone' || CAST(s_suppkey AS VARCHAR) FROM supplier), p AS (SELECT DISTINCT site, category, url FROM claims)
SELECT 'pid' AS kind, site, count(*) AS n FROM l SEMI JOIN p USING (site, category, url) GROUP BY 2 UNION ALL SELECT 'missing', site, count(*) FROM l ANTI JOIN p USING (site, category, url) GROUP BY 2
UNION ALL SELECT 'page', site, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'attribute', site, count(*) FROM claims GROUP BY 2
""")
def relational_tables(spark: SparkSession, sf: str) -> DataFrame:
    gone = B.table(spark, sf, "supplier").select(F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("pid"), F.lit("supplier").alias("site"), F.lit("geo").alias("category"), F.concat(F.lit("gone"), F.col("s_suppkey").cast("string")).alias("url"))
    made = W.relational(B.claims(spark, sf), B.linkage(spark, sf).unionByName(gone))
    out = None
    for kind in ("pid", "missing", "page", "attribute"):
        own = made[kind].groupBy("site").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "site", "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("""
WITH w AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part)
SELECT p_name, round(list_sum(list_transform(t, lambda x: least(length(x) / 10, 3.0))), 6) AS weight, coalesce(nullif(translate(p_name, '0123456789', 'ABCDEFGHIJ'), ''), 'NO_') AS label FROM w
""")
def weighted_lengths(spark: SparkSession, sf: str) -> DataFrame:
    w = B.table(spark, sf, "part").select("p_name").distinct()
    return w.select("p_name", F.round(T.weighted_length(F.array_distinct(F.split("p_name", " "))), 6).alias("weight"), T.numberless(F.col("p_name")).alias("label"))


@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents)
SELECT count(*) AS tokens, count(CASE WHEN regexp_matches(replace(token, ',', '.'), '^[0-9]+(\\.[0-9]*)?$') THEN 1 END) AS numbers FROM t
""")
def numeric_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = B.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return t.agg(F.count("*").alias("tokens"), F.count(F.when(T.is_number(F.col("token")), 1)).alias("numbers"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, c_name, '' AS later FROM customer")
def csv_there_and_back(spark: SparkSession, sf: str) -> DataFrame:
    from attrweave.operators.shared import scratch

    path = scratch(spark, "csv")
    W.csv(B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), path, ["later", "c_name"])
    return R.csv(spark, path).na.fill("")
