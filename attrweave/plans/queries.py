"""The query catalogue: one query for each operator over the driver's tables, with the same in DuckDB's SQL where it can be said.

Geo has nation, supplier and customer as sources, trade has orders and lineitem; see tables.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrweave.functions import text as T
from attrweave.functions.numbers import significant
from attrweave.operators import claims as C
from attrweave.operators import clustering as K
from attrweave.operators import evaluation as E
from attrweave.operators import linkage as L
from attrweave.operators import matching as M
from attrweave.operators import simulation as S
from attrweave.operators import stats as A
from attrweave.operators import tagging as G
from attrweave.operators.shared import cut
from attrweave.plans import tables as B
from attrweave.sources import writers as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
GEO = ("nation", "supplier", "customer")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql may use the CTEs claims, linkage and linked."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {B.SQL}, {body[5:]}" if body.startswith("WITH ") else f"WITH RECURSIVE {B.SQL} {body}"
        return f

    return register


# Domains and values


@query("SELECT site, category, name, value, count(*) AS occs FROM claims GROUP BY ALL")
def attribute_domains(spark: SparkSession, sf: str) -> DataFrame:
    return C.domains(B.claims(spark, sf))


@query("SELECT site, category, name, count(*) AS size, count(DISTINCT value) AS cardinality, count(DISTINCT url) AS pages FROM claims GROUP BY ALL")
def attribute_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return C.sizes(B.claims(spark, sf))


@query("SELECT category, value, count(DISTINCT (site, name)) AS attrs, count(DISTINCT site) AS sources FROM claims GROUP BY ALL")
def value_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return C.value_attributes(B.claims(spark, sf))


@query("""
WITH v AS (SELECT category, value, count(DISTINCT (site, name)) AS attrs FROM claims GROUP BY ALL),
a AS (SELECT category, count(DISTINCT (site, name)) AS n FROM claims GROUP BY ALL)
SELECT category, value, attrs FROM v JOIN a USING (category) WHERE attrs > 1 AND attrs > 0.2 * n
""")
def common_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.common_values(B.claims(spark, sf), least=1, ratio=0.2)


@query("SELECT category, value, count(DISTINCT site) AS sources FROM claims GROUP BY ALL HAVING count(DISTINCT site) > 1")
def non_isolated_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.non_isolated_values(B.claims(spark, sf))


@query("""
WITH d AS (SELECT site, category, name, value, count(*) AS occs FROM claims GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, category, name ORDER BY occs DESC, value) AS place FROM d) WHERE place <= 5
""")
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_values(B.claims(spark, sf), 5)


@query("""
WITH t AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT n, sum(n) AS s FROM t GROUP BY n),
h AS (SELECT n, sum(s) OVER (ORDER BY n DESC) - s < sum(s) OVER () / 2 AS head FROM g)
SELECT k, n, CASE WHEN head THEN 'HEAD' ELSE 'TAIL' END AS part FROM t JOIN h USING (n)
""")
def head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return C.head_tail(B.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n")), "n").select("k", "n", "part")


@query("""
WITH w AS (SELECT part.p_brand AS site, string_split(lower(p_name), ' ') AS ws FROM part),
s AS (SELECT site, count(*) AS size FROM w GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT site, unnest(list_distinct(ws)) AS token FROM w)
SELECT site, 'part' AS category, 'p_name' AS name, token, count(*) AS occs, max(size) AS size FROM t JOIN s USING (site) GROUP BY site, token HAVING count(*) >= 0.1 * max(size)
""")
def common_tokens(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    rows = p.select(F.col("p_brand").alias("site"), F.lit("part").alias("category"), F.col("p_partkey").cast("string").alias("url"), F.lit("p_name").alias("name"), F.col("p_name").alias("value"))
    return C.common_tokens(C.transformed(rows), 0.1)


@query("""
WITH d AS (SELECT DISTINCT p_name AS value FROM part),
t AS (SELECT value, unnest(string_split(lower(value), ' ')) AS x FROM d)
SELECT value, string_agg(x, ' ' ORDER BY x) AS tokens FROM (SELECT DISTINCT value, x FROM t) GROUP BY value
""")
def transformed_values(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part")
    rows = p.select(F.lit("part").alias("site"), F.lit("c").alias("category"), F.col("p_partkey").cast("string").alias("url"), F.lit("n").alias("name"), F.col("p_name").alias("value"))
    return C.transformed(rows).select(F.col("raw_value").alias("value"), F.array_join("value", " ").alias("tokens")).distinct()


@query("""
WITH p AS (SELECT DISTINCT site, category, url FROM linkage WHERE site = 'supplier')
SELECT site, category, name, count(*) AS kept FROM claims SEMI JOIN p USING (site, category, url) GROUP BY ALL
""")
def linked_claims(spark: SparkSession, sf: str) -> DataFrame:
    links = B.linkage(spark, sf, ("supplier",))
    return C.linked(B.claims(spark, sf, GEO), links).groupBy("site", "category", "name").agg(F.count("*").alias("kept"))


@query("""
WITH p AS (SELECT * FROM linkage WHERE site = 'supplier')
SELECT site, name, count(*) AS n, count(pid) AS linked FROM (SELECT * FROM claims WHERE category = 'geo') LEFT JOIN p USING (site, category, url) GROUP BY ALL
""")
def tail_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_pids(B.claims(spark, sf, GEO), B.linkage(spark, sf, ("supplier",)))
    return rows.groupBy("site", "name").agg(F.count("*").alias("n"), F.count("pid").alias("linked"))


@query("""
WITH r AS (SELECT DISTINCT user_id AS k, CAST(floor(value / 20) AS BIGINT) AS e FROM events),
s AS (SELECT k, count(*) AS n FROM r GROUP BY k),
c AS (SELECT a.k AS x, b.k AS y, count(*) AS m FROM r a JOIN r b ON a.e = b.e AND a.k <> b.k GROUP BY ALL)
SELECT DISTINCT x AS k FROM c JOIN s p ON p.k = x JOIN s q ON q.k = y WHERE m = p.n AND (p.n < q.n OR x < y)
""")
def contained_sets(spark: SparkSession, sf: str) -> DataFrame:
    return C.contained_sets(B.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.floor(F.col("value") / 20).alias("e")), "k", "e")


# Strings


@query("""
WITH u AS (SELECT DISTINCT url FROM pages),
a AS (SELECT url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS r FROM u),
b AS (SELECT url, replace(regexp_extract(r, '^([^/?]*)', 1), 'www.', '') AS host, trim(regexp_replace(regexp_extract(regexp_replace(r, '^[^/?]*', ''), '^([^?]*)', 1), '/+', '/', 'g'), '/') AS path, regexp_extract(r, '^[^?]*(\\?.+)$', 1) AS q FROM a)
SELECT url, 'http://' || host || CASE WHEN path <> '' THEN '/' || path ELSE '' END || q AS normal FROM b
""")
def normalized_urls(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "pages").select("url").distinct().select("url", T.normalize_url(F.col("url")).alias("normal"))


@query("""
WITH h AS (SELECT doc_id, text AS s FROM documents)
SELECT doc_id, trim(regexp_replace(trim(lower(s), ' ,.;:'), '\\s+', ' ', 'g')) AS normal FROM h
""")
def normalized_values(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", T.normalize_keyvalue(F.col("text")).alias("normal"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents(replace(text, 'ß', ''))), '[0-9]+[.,]?[0-9]*|[a-z]+'), ' ') AS folded FROM documents")
def folded_texts(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT host, coalesce(list_filter(string_split(host, '.'), lambda x: x NOT IN ('com', 'net', 'org'))[-1], host) AS short FROM h
""")
def short_site_names(spark: SparkSession, sf: str) -> DataFrame:
    hosts = B.table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host")).distinct()
    return hosts.select("host", T.short_site_name(F.col("host")).alias("short"))


@query("""
WITH w AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part),
p AS (SELECT a.p_name AS x, b.p_name AS y, len(list_intersect(a.t, b.t)) * 0.5 AS i, len(list_distinct(list_concat(a.t, b.t))) * 0.5 AS u, least(len(a.t), len(b.t)) * 0.5 AS m FROM w a JOIN w b ON a.p_name < b.p_name)
SELECT x, y, round(i / u, 6) AS jaccard, round(i / m, 6) AS containment FROM p
""")
def token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    w = B.table(spark, sf, "part").select("p_name").distinct().withColumn("t", F.array_distinct(F.split("p_name", " ")))
    a, b = w.select(F.col("p_name").alias("x"), F.col("t").alias("tx")), w.select(F.col("p_name").alias("y"), F.col("t").alias("ty"))
    met = a.join(b, F.col("x") < F.col("y"))
    return met.select("x", "y", F.round(T.weighted_jaccard(F.col("tx"), F.col("ty")), 6).alias("jaccard"), F.round(T.weighted_containment(F.col("tx"), F.col("ty")), 6).alias("containment"))


@query("""
WITH n AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS token FROM orders), u AS (SELECT token, CAST(token AS BIGINT) AS x, CAST(pow(10, greatest(length(token) - 2, 0)) AS BIGINT) AS unit FROM n),
q AS (SELECT *, x // unit AS d, x % unit AS r FROM u)
SELECT token, CASE WHEN x = 0 THEN '0' ELSE CAST((d + CASE WHEN 2 * r > unit OR (2 * r = unit AND d % 2 = 1) THEN 1 ELSE 0 END) * unit AS VARCHAR) || '.0' END AS rounded FROM q
""")
def rounded_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("token")).distinct()
    return n.select("token", T.round_significant(F.col("token")).alias("rounded"))


# Matching


@query("""
WITH d AS (SELECT DISTINCT category, pid, value, site, name FROM linked)
SELECT category, a.site AS site1, a.name AS name1, b.site AS site2, b.name AS name2, count(*) AS common
FROM d a JOIN d b USING (category, pid, value) WHERE a.site < b.site GROUP BY ALL
""")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return M.candidates(B.linked(spark, sf))


_MATCHES = """
d AS (SELECT DISTINCT category, pid, value, site, name FROM linked WHERE category = 'trade'),
pairs AS (SELECT category, a.site AS site1, a.name AS name1, b.site AS site2, b.name AS name2 FROM d a JOIN d b USING (category, pid, value) WHERE a.site < b.site GROUP BY ALL),
l AS (SELECT category, pid, site, name, value, count(*) OVER (PARTITION BY category, pid, site, name) AS n FROM linked WHERE category = 'trade'),
m AS (
  SELECT p.*, x.pid, x.value AS value1, y.value AS value2, x.n AS n1, y.n AS n2, 1.0 / (x.n * y.n) AS w
  FROM pairs p JOIN l x ON x.category = p.category AND x.site = p.site1 AND x.name = p.name1
  JOIN l y ON y.category = p.category AND y.pid = x.pid AND y.site = p.site2 AND y.name = p.name2
)
"""


def _matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = B.linked(spark, sf, ("orders", "lineitem"))
    return M.counted_matches(cut(M.candidates(rows)), rows), B.claims(spark, sf, ("orders", "lineitem"))


@query(f"WITH {_MATCHES} SELECT category, site1, name1, site2, name2, count(*) AS matches, count(DISTINCT pid) AS entities, round(sum(w), 6) AS weight FROM m GROUP BY ALL")
def value_matches(spark: SparkSession, sf: str) -> DataFrame:
    m, _ = _matches(spark, sf)
    return m.groupBy(*M.PAIR).agg(F.sum("m").alias("matches"), F.countDistinct("pid").alias("entities"), F.round(F.sum("w"), 6).alias("weight"))


@query(f"""
WITH {_MATCHES},
c AS (SELECT * FROM claims WHERE category = 'trade'),
dom AS (SELECT site, name, value, count(*) AS d FROM c GROUP BY ALL),
siz AS (SELECT site, name, count(*) AS n FROM c GROUP BY ALL),
att AS (SELECT value, count(DISTINCT (site, name)) AS attrs FROM c GROUP BY ALL),
f AS (
  SELECT m.*, s1.n AS s1, s2.n AS s2, a1.d AS d11, coalesce(b1.d, 0) AS d21, coalesce(a2.d, 0) AS d12, b2.d AS d22
  FROM m JOIN siz s1 ON s1.site = site1 AND s1.name = name1 JOIN siz s2 ON s2.site = site2 AND s2.name = name2
  JOIN dom a1 ON a1.site = site1 AND a1.name = name1 AND a1.value = value1
  LEFT JOIN dom b1 ON b1.site = site2 AND b1.name = name2 AND b1.value = value1
  LEFT JOIN dom a2 ON a2.site = site1 AND a2.name = name1 AND a2.value = value2
  JOIN dom b2 ON b2.site = site2 AND b2.name = name2 AND b2.value = value2
), g AS (SELECT *, (d11 + d21) / (s1 + s2) AS f1, (d12 + d22) / (s1 + s2) AS f2, d11 * d22 / (s1 * s2) AS neg, 0.1 * 1.9 AS e FROM f),
h AS (SELECT *, CASE WHEN value1 = value2 THEN f1 * (1 - e * (1 - f1)) ELSE e * f1 * f2 END AS pos FROM g),
s AS (SELECT site1, name1, site2, name2, max(s1) AS s1, max(s2) AS s2, count(*) AS matches, sum(w) AS weight, sum(w * ln(pos)) AS lp, sum(w * ln(neg)) AS ln_ FROM h GROUP BY ALL),
oa AS (SELECT site1, name1, site2, name2, sum(2 * least(a.d / s1, b.d / s2) / attrs) AS v FROM s JOIN dom a ON a.site = site1 AND a.name = name1 JOIN dom b ON b.site = site2 AND b.name = name2 AND b.value = a.value JOIN att ON att.value = a.value GROUP BY ALL),
l1 AS (SELECT site1, name1, site2, name2, value1 AS value, sum(w) AS l FROM m GROUP BY ALL),
l2 AS (SELECT site1, name1, site2, name2, value2 AS value, sum(w) AS l FROM m GROUP BY ALL),
ol AS (SELECT site1, name1, site2, name2, sum(2 * least(l1.l, l2.l) / weight / attrs) AS v FROM l1 JOIN l2 USING (site1, name1, site2, name2, value) JOIN att USING (value) JOIN s USING (site1, name1, site2, name2) GROUP BY ALL),
q AS (SELECT s.*, coalesce(oa.v, 0) AS whole, coalesce(ol.v, 0) AS link, ln(greatest(s1, s2)) AS depth FROM s LEFT JOIN oa USING (site1, name1, site2, name2) LEFT JOIN ol USING (site1, name1, site2, name2)),
z AS (SELECT *, least(greatest(0.9 * CASE WHEN depth = 0 THEN link ELSE ln(matches) / depth * (link - whole) + whole END, 1e-100), 1 - 1e-100) AS prior, lp - ln_ AS odds FROM q)
SELECT 'trade' AS category, site1, name1, site2, name2, matches, round(prior, 6) AS prior, round(CASE WHEN odds > 50 THEN 1 WHEN odds < -50 THEN 0 ELSE 1 / (1 + exp(-odds) * (1 - prior) / prior) END, 6) AS p FROM z
""")
def match_probability(spark: SparkSession, sf: str) -> DataFrame:
    m, c = _matches(spark, sf)
    return M.probabilities(m, c).select(*M.PAIR, "matches", F.round("prior", 6).alias("prior"), F.round("p", 6).alias("p"))


@query("""
WITH d AS (SELECT category, site, name, value, count(*) AS o FROM claims WHERE category = 'trade' GROUP BY ALL),
a AS (SELECT DISTINCT category, site, name FROM d),
p AS (SELECT a.category, a.site AS site1, a.name AS name1, b.site AS site2, b.name AS name2 FROM a JOIN a b USING (category) WHERE a.site < b.site),
x AS (SELECT p.*, value, o FROM p JOIN d ON d.site = site1 AND d.name = name1),
y AS (SELECT p.*, value, o FROM p JOIN d ON d.site = site2 AND d.name = name2)
SELECT category, site1, name1, site2, name2, round(sum(least(coalesce(x.o, 0), coalesce(y.o, 0))) / sum(greatest(coalesce(x.o, 0), coalesce(y.o, 0))), 6) AS similarity
FROM x FULL JOIN y USING (category, site1, name1, site2, name2, value) GROUP BY ALL
""")
def domain_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    c = B.claims(spark, sf, ("orders", "lineitem"))
    a = c.select("category", "site", "name").distinct()
    p = a.withColumnsRenamed({"site": "site1", "name": "name1"}).join(a.withColumnsRenamed({"site": "site2", "name": "name2"}), "category").filter("site1 < site2")
    return M.domain_jaccard(C.domains(c), p).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH v AS (SELECT category, value, count(DISTINCT (site, name)) AS attrs FROM claims GROUP BY ALL),
w AS (SELECT category, count(DISTINCT (site, name)) AS n FROM claims GROUP BY ALL),
r AS (SELECT category, value FROM v JOIN w USING (category) WHERE attrs < 0.5 * n),
s AS (SELECT category, site, name, count(*) AS n FROM claims GROUP BY ALL),
d AS (SELECT category, site, name, value, count(*) AS o FROM claims GROUP BY ALL),
e AS (SELECT d.*, n FROM d JOIN s USING (category, site, name) SEMI JOIN r USING (category, value))
SELECT category, a.site AS site1, a.name AS name1, b.site AS site2, b.name AS name2, count(*) AS shared, round(sum(least(a.o / a.n, b.o / b.n)) / greatest(max(a.n), max(b.n)), 9) AS similarity
FROM e a JOIN e b USING (category, value) WHERE a.site < b.site GROUP BY ALL HAVING count(*) >= 2
""")
def domain_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return M.domain_similarity(B.claims(spark, sf), most_share=0.5).withColumn("similarity", F.round("similarity", 9))


@query("""
WITH s AS (SELECT DISTINCT category, pid, site FROM linkage)
SELECT category, a.site AS site1, b.site AS site2, count(*) AS entities FROM s a JOIN s b USING (category, pid) WHERE a.site < b.site GROUP BY ALL
""")
def shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    return M.shared_entities(B.linkage(spark, sf))


@query("""
WITH b AS (SELECT DISTINCT event_type AS g, user_id AS i, CAST(floor(value * 10) AS BIGINT) AS k FROM events)
SELECT x.g AS g1, x.i AS i1, y.g AS g2, y.i AS i2, count(*) * 2 AS score FROM b x JOIN b y USING (k) WHERE x.g < y.g GROUP BY ALL HAVING count(*) * 2 >= 4
""")
def metablocking(spark: SparkSession, sf: str) -> DataFrame:
    b = B.table(spark, sf, "events").select(F.col("event_type").alias("g"), F.col("user_id").alias("i"), F.floor(F.col("value") * 10).alias("k"), F.lit(2).cast("long").alias("s"))
    return M.blocked_pairs(b, "g", "i", "k", "s", 4)


# Clusters


def _nodes(c: DataFrame) -> DataFrame:
    node = F.concat_ws("//", "category", "site", "name")
    return c.groupBy("category", "site", "name").agg(F.lit(1).alias("x")).select(node.alias("node"), F.concat_ws("__", "site", "category").alias("source"), F.lit(False).alias("master"), F.array(F.concat_ws("//", "category", "site")).alias("urls"), "category", "site", "name")


@query("""
WITH r AS (SELECT o_custkey, least(o_custkey * 2, min(o_orderkey * 2 + 1)) AS root FROM orders GROUP BY 1)
SELECT o_custkey * 2 AS node, root FROM r UNION ALL SELECT o_orderkey * 2 + 1, root FROM orders JOIN r USING (o_custkey)
""")
def order_components(spark: SparkSession, sf: str) -> DataFrame:
    from attrweave.operators.shared import components

    # Each order has one customer, so components are stars, which SQL can say.
    o = B.table(spark, sf, "orders")
    return components(o.select((F.col("o_custkey") * 2).alias("n1"), (F.col("o_orderkey") * 2 + 1).alias("n2")))


@query()
def classic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c, rows = B.claims(spark, sf, GEO), B.linked(spark, sf, GEO)
    return K.cluster(M.edges(M.probabilities(M.counted_matches(cut(M.candidates(rows)), rows), c), 0.2), _nodes(c), "same_page")


@query()
def name_baseline(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "conversations")
    rows = d.select(F.col("role").alias("site"), F.lit("chat").alias("category"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("name"), F.explode(F.array_distinct(F.split(F.trim(F.col("text")), r"\s+"))).alias("value")).filter("value <> ''")
    return K.cluster(K.by_name(rows, frequent=True), _nodes(rows), "source")


@query("""
WITH k AS (SELECT o_custkey % 200 AS cid, o_orderpriority AS real FROM orders),
c AS (SELECT cid, real, count(*) AS n FROM k GROUP BY ALL),
t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c)::BIGINT AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY cid))::BIGINT AS computed, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY real))::BIGINT AS expected)
SELECT tp, computed, expected FROM t
""")
def cluster_pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 200).alias("cid"), F.col("o_orderpriority").alias("real"))
    return E.by_cells(k, "node", "cid", "real").select("tp", "computed", "expected")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS cid FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS node, l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS cid FROM lineitem),
p AS (SELECT DISTINCT x.node AS n1, y.node AS n2 FROM a x JOIN a y USING (cid) WHERE x.node < y.node), q AS (SELECT DISTINCT x.node AS n1, y.node AS n2 FROM b x JOIN b y USING (cid) WHERE x.node < y.node)
SELECT (SELECT count(*) FROM p SEMI JOIN q USING (n1, n2)) AS tp, (SELECT count(*) FROM p) AS computed, (SELECT count(*) FROM q) AS expected
""")
def schema_level_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    a = li.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("cid")).distinct()
    b = li.select(F.col("l_orderkey").alias("node"), (F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("cid")).distinct()
    return E.schema_level(a, b).select("tp", "computed", "expected")


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS n, CAST(floor(c_acctbal / 1000) AS BIGINT) AS b FROM customer), b AS (SELECT DISTINCT s_nationkey AS n, CAST(floor(s_acctbal / 1000) AS BIGINT) AS b FROM supplier)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS fp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS fn
""")
def set_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c, s = B.table(spark, sf, "customer"), B.table(spark, sf, "supplier")
    return E.set_counts(c.select(F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 1000).alias("b")), s.select(F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 1000).alias("b")))


@query("""
WITH n AS (SELECT c_custkey AS node, c_nationkey AS target, c_mktsegment AS found FROM customer),
m AS (SELECT target, found, count(*) AS tp FROM n GROUP BY ALL), e AS (SELECT target, count(*) AS expected FROM n GROUP BY 1), c AS (SELECT found, count(*) AS computed FROM n GROUP BY 1)
SELECT target, max(tp / expected) AS recall FROM m JOIN e USING (target) GROUP BY target
""")
def best_target_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    met = c.groupBy(F.col("c_nationkey").alias("target"), "c_mktsegment").agg(F.count("*").alias("tp"))
    return met.groupBy("target").agg((F.max("tp") / F.sum("tp")).alias("recall"))


# Statistics


@query("""
WITH p AS (SELECT site, category, url, count(DISTINCT name) AS a FROM claims GROUP BY ALL), q AS (SELECT site, category, count(*) AS pages, median(a)::DOUBLE AS median_attrs FROM p GROUP BY ALL),
u AS (SELECT site, category, name, count(DISTINCT url) AS n FROM claims GROUP BY ALL)
SELECT site, category, max(pages) AS pages, count(*) AS schema_size, max(median_attrs) AS median_attrs, round(avg(n / pages), 6) AS avg_use, count(CASE WHEN n / pages >= 0.1 THEN 1 END) AS over_10, count(CASE WHEN n / pages >= 0.55 THEN 1 END) AS over_55, count(CASE WHEN n / pages >= 0.85 THEN 1 END) AS over_85, count(CASE WHEN n / pages >= 0.95 THEN 1 END) AS over_95, max(n) AS top_pages
FROM u JOIN q USING (site, category) GROUP BY ALL
""")
def source_schema_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.source_schema(B.claims(spark, sf))


@query("""
WITH u AS (SELECT site, category, name, count(DISTINCT url) AS n FROM claims GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY n DESC, name) AS a, row_number() OVER (PARTITION BY site, category ORDER BY n, name) AS b FROM u)
SELECT site, category, string_agg(name, '|' ORDER BY a) FILTER (a <= 3) AS top, string_agg(name, '|' ORDER BY b) FILTER (b <= 3) AS bottom FROM r GROUP BY ALL
""")
def source_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return A.source_attributes(B.claims(spark, sf))


@query("""
WITH c AS (SELECT category, count(DISTINCT site) AS sources, count(DISTINCT (site, url)) AS pages, count(DISTINCT (site, name)) AS attributes, count(*) AS instances, count(DISTINCT value) AS distinct_values FROM claims GROUP BY 1),
l AS (SELECT category, count(DISTINCT (site, url)) AS linked_pages, count(DISTINCT pid) AS entities FROM linkage GROUP BY 1), r AS (SELECT * FROM c JOIN l USING (category))
SELECT * FROM r UNION ALL SELECT 'ALL', sum(sources), sum(pages), sum(attributes), sum(instances), sum(distinct_values), sum(linked_pages), sum(entities) FROM r
""")
def general_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.general(B.claims(spark, sf), B.linkage(spark, sf))


@query("""
WITH s AS (SELECT site, category, name, value, count(*) AS n FROM claims GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site, category, name ORDER BY n DESC, value) AS k FROM s),
p AS (SELECT site, category, count(DISTINCT url) AS pages FROM claims GROUP BY ALL)
SELECT site, category, name, sum(n)::BIGINT AS size, count(*) AS domain, string_agg(value, '|' ORDER BY k) FILTER (k <= 4) AS top, round(sum(n) / max(pages), 6) AS ratio FROM r JOIN p USING (site, category) GROUP BY ALL
""")
def attribute_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return A.attribute_analysis(B.claims(spark, sf))


@query("""
WITH s AS (SELECT DISTINCT category, url, names FROM (SELECT event_type AS category, user_id AS url, string_agg(DISTINCT CAST(floor(value / 40) AS BIGINT)::VARCHAR, ',') AS x, list_sort(list_distinct(list(CAST(floor(value / 40) AS BIGINT)::VARCHAR))) AS names FROM events GROUP BY ALL)),
d AS (SELECT DISTINCT category, names FROM s), m AS (SELECT category, avg(len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names)))) AS j FROM d a JOIN d b USING (category) WHERE a.names < b.names GROUP BY 1)
SELECT 'events' AS site, category, count(*) AS schemas, round(coalesce(max(j), 1.0), 6) AS homogeneity FROM d LEFT JOIN m USING (category) GROUP BY ALL
""")
def source_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    return A.homogeneity(e.select(F.lit("events").alias("site"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("url"), F.floor(F.col("value") / 40).cast("string").alias("name")))


_PARTS = "SELECT 'p' AS category, CAST(p_size % 4 AS VARCHAR) AS site, CAST(p_partkey AS VARCHAR) AS url, n AS name, v AS value FROM (SELECT p_size, p_partkey, unnest(['brand', 'type', 'size', 'name']) AS n, unnest([p_brand, p_type, CAST(p_size AS VARCHAR), p_name]) AS v FROM part)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").withColumnsRenamed({"p_brand": "brand", "p_type": "type", "p_name": "name0"}).withColumn("size", F.col("p_size").cast("string"))
    rows = C.from_wide(p, F.col("p_size") % 4, F.lit("p"), F.col("p_partkey"), ["brand", "type", "size", "name0"])
    return rows.withColumn("name", F.when(F.col("name") == "name0", "name").otherwise(F.col("name")))


@query(f"""
WITH c AS ({_PARTS}), h AS (SELECT DISTINCT category, site || '//' || url AS p, name, value FROM c),
r AS (SELECT category, name, value FROM h GROUP BY ALL HAVING count(*) < 90 AND count(*) > 1), x AS (SELECT h.* FROM h SEMI JOIN r USING (category, name, value)),
s AS (SELECT a.category, a.p AS p1, b.p AS p2, count(*) AS shared FROM x a JOIN x b USING (category, name, value) WHERE a.p < b.p GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT p, count(*) AS n FROM h GROUP BY 1)
SELECT category, p1, p2, shared, round(shared / least(a.n, b.n), 6) AS ratio FROM s JOIN n a ON a.p = p1 JOIN n b ON b.p = p2 WHERE shared / least(a.n, b.n) > 0.3
""")
def copied_pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.copies(_parts(spark, sf), most_pages=90, least_shared=2, ratio=0.3)


@query(f"""
WITH h AS (SELECT DISTINCT category, site, url, name, lower(array_to_string(regexp_extract_all(value, '[0-9]+[.,]?[0-9]*|[a-zA-Z]+'), ' ')) AS value FROM ({_PARTS})), n AS (SELECT category, site, url, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT a.category, a.site AS site1, a.url AS url1, b.site AS site2, b.url AS url2, count(*) AS shared FROM h a JOIN h b USING (category, name, value) WHERE (a.site, a.url) < (b.site, b.url) GROUP BY ALL HAVING count(*) >= 3)
SELECT s.*, round(shared / greatest(x.n, y.n), 6) AS ratio FROM s JOIN n x ON x.category = s.category AND x.site = site1 AND x.url = url1 JOIN n y ON y.category = s.category AND y.site = site2 AND y.url = url2 WHERE shared / greatest(x.n, y.n) > 0.9
""")
def page_copies(spark: SparkSession, sf: str) -> DataFrame:
    return A.page_copies(_parts(spark, sf))


@query(f"""
WITH c AS (SELECT DISTINCT category, site, url, value FROM ({_PARTS})), w AS (SELECT category, value, count(*) AS n FROM c GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60)
SELECT category, a.site AS site1, a.url AS url1, b.site AS site2, b.url AS url2, round(sum(1 / n), 6) AS score
FROM c a JOIN c b USING (category, value) JOIN w USING (category, value) WHERE a.site < b.site GROUP BY ALL HAVING round(sum(1 / n), 6) > 0.03
""")
def potential_linkages(spark: SparkSession, sf: str) -> DataFrame:
    return A.potential_linkages(_parts(spark, sf), most_pages=60, least=0.03)


_KEYED = "SELECT 'k' AS category, 'customer' AS site, CAST(c_custkey AS VARCHAR) AS url, unnest([CAST(c_custkey AS VARCHAR), c_mktsegment]) AS value FROM customer UNION ALL SELECT 'k', 'orders', CAST(o_orderkey AS VARCHAR), unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) FROM orders"


@query(f"""
WITH c AS (SELECT DISTINCT category, site, url, value FROM ({_KEYED}) WHERE value IS NOT NULL), w AS (SELECT category, value, count(*) AS n FROM c GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100)
SELECT category, a.site AS site1, a.url AS url1, b.site AS site2, b.url AS url2, round(sum(1 / n), 6) AS score
FROM c a JOIN c b USING (category, value) JOIN w USING (category, value) WHERE a.site < b.site GROUP BY ALL HAVING round(sum(1 / n), 6) > 0.1
""")
def key_linkages(spark: SparkSession, sf: str) -> DataFrame:
    # Customer keys are on few pages at every size; segments, states and priorities are dropped as popular.
    c, o = B.table(spark, sf, "customer"), B.table(spark, sf, "orders")
    rows = C.from_wide(c, F.lit("customer"), F.lit("k"), F.col("c_custkey"), ["c_custkey", "c_mktsegment"])
    return A.potential_linkages(rows.unionByName(C.from_wide(o, F.lit("orders"), F.lit("k"), F.col("o_orderkey"), ["o_custkey", "o_orderstatus", "o_orderpriority"])))


@query("""
WITH p AS (SELECT category, site, url, count(DISTINCT pid) AS p FROM linkage GROUP BY ALL), m AS (SELECT category, count(*) AS pages, count(CASE WHEN p > 1 THEN 1 END) AS multi_pages FROM p GROUP BY 1),
e AS (SELECT category, pid, count(*) AS n, count(DISTINCT site) AS s FROM linkage GROUP BY ALL)
SELECT category, max(pages) AS pages, max(multi_pages) AS multi_pages, count(*) AS entities, sum(n * (n - 1) // 2)::BIGINT AS pairs, count(CASE WHEN n > s THEN 1 END) AS conflicting FROM e JOIN m USING (category) GROUP BY category
""")
def linkage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.linkage_stats(B.linkage(spark, sf))


@query("""
WITH s AS (SELECT category, pid, count(*) AS n FROM linkage GROUP BY ALL)
SELECT category, CAST(floor(log10(n) / 0.5 + 1e-9) AS INT) AS bucket, count(*) AS entities, sum(n)::BIGINT AS pages FROM s GROUP BY ALL
""")
def entity_size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return A.size_buckets(B.linkage(spark, sf))


@query("""
WITH c AS (SELECT event_type, floor(value / 5) AS b, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT event_type, sum(n) AS t FROM c GROUP BY 1)
SELECT event_type, round(sum(-(n / t) * ln(n / t)), 6) AS entropy, count(*) AS buckets FROM c JOIN t USING (event_type) GROUP BY 1
""")
def value_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return A.entropy(B.table(spark, sf, "events"), "value", 5.0, ["event_type"])


@query("""
WITH t AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT n, sum(n) AS s FROM t GROUP BY n), h AS (SELECT n, sum(s) OVER (ORDER BY n DESC) - s < sum(s) OVER () / 2 AS head FROM g), r AS (SELECT t.n, head FROM t JOIN h USING (n))
SELECT count(n) AS all_n, round(avg(n), 6) AS all_mean, median(n)::DOUBLE AS all_median, count(n) FILTER (head) AS head_n, round(avg(n) FILTER (head), 6) AS head_mean, (median(n) FILTER (head))::DOUBLE AS head_median, count(n) FILTER (NOT head) AS tail_n, round(avg(n) FILTER (NOT head), 6) AS tail_mean, (median(n) FILTER (NOT head))::DOUBLE AS tail_median FROM r
""")
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_sizes(B.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n")


@query("SELECT site, category, name, count(*) AS linked_pages FROM linked GROUP BY ALL")
def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    return A.linked_pages(B.claims(spark, sf), B.linkage(spark, sf))


@query("""
WITH s AS (SELECT site, category, name, count(*) AS size FROM claims GROUP BY ALL), k AS (SELECT *, CASE WHEN name LIKE '%key' THEN right(name, 9) END AS cid FROM s)
SELECT count(*) AS attributes, round(count(cid) / count(*), 6) AS clustered_part, round(count(cid) / count(DISTINCT cid), 6) AS avg_size, round(sum(CASE WHEN cid IS NOT NULL THEN size ELSE 0 END) / sum(size), 6) AS claims_part FROM k
""")
def clustering_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = C.sizes(B.claims(spark, sf))
    return A.clustering_stats(s.filter("name like '%key'").select(F.expr("right(name, 9)").alias("cid"), "site", "category", "name"), s)


# Tags, linkage, simulation, sinks


@query("""
WITH g AS (SELECT string_split(text, ' ') AS w FROM benchmark), h AS (SELECT generate_subscripts(w, 1) AS i, w FROM g), d AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM h WHERE i + 1 < len(w)),
t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM t), b AS (SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM n WHERE i + 1 < len(w))
SELECT doc_id, place, gram FROM b SEMI JOIN d USING (gram)
""")
def tagged_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    cut = lambda df, *keep: df.select(*keep, F.posexplode(F.transform(T.ngrams(F.split("text", " "), 3), lambda g: F.array_join(g, " "))).alias("place", "gram"))
    return cut(B.table(spark, sf, "documents"), "doc_id").join(cut(B.table(spark, sf, "benchmark")).select("gram").distinct(), "gram", "left_semi").select("doc_id", "place", "gram")


def _tagging(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = B.table(spark, sf, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("value")).distinct()
    known = words.select("value", F.array(F.length("value").cast("long")).alias("clusters"))
    values = p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("value"), F.lit(4).cast("long").alias("own")).distinct()
    return values, known


@query("""
WITH v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS value FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS gram FROM part),
t AS (SELECT value, unnest(string_split(value, ' ')) AS gram, generate_subscripts(string_split(value, ' '), 1) - 1 AS place FROM v)
SELECT value, 4 AS own, place, gram, length(gram) AS cluster FROM t SEMI JOIN w USING (gram) WHERE length(gram) <> 4
""")
def tags_every_combination(spark: SparkSession, sf: str) -> DataFrame:
    return G.tag_all(*_tagging(spark, sf), most=1)


@query("""
WITH v AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS value FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS gram FROM part),
t AS (SELECT value, unnest(string_split(value, ' ')) AS gram FROM v)
SELECT value, 4 AS own, gram, length(gram) AS cluster FROM t SEMI JOIN w USING (gram) WHERE length(gram) <> 4
""")
def tags_longest_first(spark: SparkSession, sf: str) -> DataFrame:
    return G.tag_longest(*_tagging(spark, sf), most=3)


@query("""
WITH k AS (SELECT (CASE WHEN name LIKE '%nationkey' THEN 1 WHEN name LIKE '%status' THEN 2 END) AS cid, category || '//' || site || '//' || name AS node, value FROM claims WHERE length(value) BETWEEN 1 AND 20),
h AS (SELECT cid, value FROM k WHERE cid IS NOT NULL GROUP BY ALL HAVING count(DISTINCT node) >= 2), n AS (SELECT count(DISTINCT cid) + count(DISTINCT CASE WHEN cid IS NULL THEN node END) AS n FROM k)
SELECT value, string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) AS clusters FROM h CROSS JOIN n GROUP BY value HAVING count(*) / max(n) <= 0.5
""")
def value_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.claims(spark, sf).withColumn("node", F.concat_ws("//", "category", "site", "name"))
    cid = F.when(F.col("name").like("%nationkey"), 1).when(F.col("name").like("%status"), 2)
    clustered = rows.select(cid.alias("cid"), "node").distinct().filter("cid is not null")
    return G.dictionary(clustered, rows, shortest=1, longest=20).select("value", F.array_join(F.transform("clusters", lambda x: x.cast("string")), ",").alias("clusters"))


@query("""
WITH r AS (SELECT DISTINCT category, site, url, value FROM claims WHERE category = 'geo'), p AS (SELECT site, category, count(DISTINCT url) AS size FROM r GROUP BY ALL),
v AS (SELECT category, value FROM r GROUP BY ALL HAVING count(DISTINCT site) > 1), x AS (SELECT r.* FROM r SEMI JOIN v USING (category, value)), n AS (SELECT site, category, value, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT n.*, size, row_number() OVER w AS place, sum(n) OVER w AS volume FROM n JOIN p USING (site, category) WINDOW w AS (PARTITION BY site, category ORDER BY n, value ROWS UNBOUNDED PRECEDING)),
f AS (SELECT site, category, url, min(place) AS place FROM x JOIN k USING (site, category, value) GROUP BY ALL), g AS (SELECT site, category, place, count(*) AS fresh FROM f GROUP BY ALL),
c AS (SELECT k.*, sum(coalesce(fresh, 0)) OVER (PARTITION BY site, category ORDER BY place ROWS UNBOUNDED PRECEDING) AS covered FROM k LEFT JOIN g USING (site, category, place)),
e AS (SELECT *, min(CASE WHEN (covered >= size AND n > least(size - 1, 4)) OR volume > 2 * size OR n > 30 THEN place END) OVER (PARTITION BY site, category) AS stop FROM c)
SELECT site, category, value, n, place FROM e WHERE stop IS NULL OR place <= stop
""")
def rare_values(spark: SparkSession, sf: str) -> DataFrame:
    c = B.claims(spark, sf, GEO)
    return L.rare_values(c, c.select("category", "value").limit(0))


@query("""
WITH s AS (SELECT pid, count(*) AS n FROM linkage WHERE category = 'geo' GROUP BY 1), o AS (SELECT pid, coalesce(sum(n) OVER (ORDER BY n DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS whole FROM s)
SELECT pid, site, category, url FROM linkage SEMI JOIN (SELECT pid FROM o WHERE before >= 0.34 * whole) USING (pid)
""")
def removed_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return S.remove_linkage(B.linkage(spark, sf, GEO), 0.66, "KEEP_SMALL").select("pid", "site", "category", "url")


@query("SELECT site, category, url, name, value FROM claims WHERE site IN (SELECT site FROM linkage GROUP BY site ORDER BY (site <> 'nation'), count(*) DESC, site LIMIT 2)")
def kept_sources(spark: SparkSession, sf: str) -> DataFrame:
    return S.keep_sources(B.claims(spark, sf), B.linkage(spark, sf), 2, "MORE", ["nation"]).select("site", "category", "url", "name", "value")


@query("SELECT event_type, count(*) AS n, greatest(1, round(count(*) / 50.0))::BIGINT AS kept FROM events GROUP BY 1")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    got = S.stratified(e, [F.col("event_type")], 50, "event_id").groupBy("event_type").agg(F.count("*").alias("kept"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(got, "event_type").select("event_type", "n", "kept")


@query("""
WITH a AS (SELECT l.pid, c.site, c.url, c.name, min(c.value) AS value FROM claims c JOIN linkage l USING (site, category, url) WHERE c.name LIKE '%nationkey' GROUP BY ALL)
SELECT pid, 'nationkey__1' AS target, string_agg(site || '#-#' || url || '/' || name || '=' || value, '|' ORDER BY site || '#-#' || url || '/' || name || '=' || value) AS provenances FROM a GROUP BY pid
""")
def instance_graph(spark: SparkSession, sf: str) -> DataFrame:
    c = B.claims(spark, sf, GEO)
    clustered = c.filter("name like '%nationkey'").select("site", "category", "name", F.lit(1).alias("cid")).distinct()
    labels = spark.createDataFrame([(1, "nationkey")], "cid int, label string")
    return W.instance_graph(c, B.linkage(spark, sf, GEO), clustered, labels).withColumn("provenances", F.array_join("provenances", "|"))


@query("SELECT pid, site || '__' || category AS source, url, name, value, false AS additional FROM linked WHERE category = 'geo'")
def long_table(spark: SparkSession, sf: str) -> DataFrame:
    return W.long_table(B.claims(spark, sf, GEO), B.linkage(spark, sf, GEO))


@query("SELECT CAST(c_custkey AS VARCHAR) AS url, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, c_name FROM customer")
def pivoted_source(spark: SparkSession, sf: str) -> DataFrame:
    return W.pivoted(B.claims(spark, sf, GEO), "customer", "geo", ["c_nationkey", "c_mktsegment", "c_name"])


@query("""
WITH u AS (SELECT DISTINCT pid, site || '//' || url AS p FROM linkage WHERE category = 'trade')
SELECT count(*) AS pairs FROM (SELECT DISTINCT a.p, b.p AS q FROM u a JOIN u b USING (pid) WHERE a.p < b.p)
""")
def linked_url_pairs(spark: SparkSession, sf: str) -> DataFrame:
    u = B.linkage(spark, sf, ("orders", "lineitem")).select("pid", F.concat_ws("//", "site", "url").alias("p")).distinct()
    return E.pair_counts(u.select(F.col("p").alias("node"), F.col("pid").alias("cid"))).select(F.col("computed").alias("pairs"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0.0 ELSE round(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2)) * pow(10, floor(log10(o_totalprice)) - 2) END AS price FROM orders")
def significant_prices(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "orders").select("o_orderkey", significant(F.col("o_totalprice"), 3).alias("price"))


from attrweave.plans import queries_runs  # noqa: E402, F401  registers its queries
