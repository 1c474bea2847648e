import pytest

from attrweave.operators import claims as C
from attrweave.operators import evaluation as E
from attrweave.operators import linkage as L
from attrweave.operators import matching as M

SCHEMA = "site string, category string, url string, name string, value string"


@pytest.fixture
def golden(spark):
    """Two attributes of two sources, of one word in three in common by name; three of their pages are linked."""
    rows = [("s1", "c", f"a{k}", "x y", v) for k, v in enumerate(["red", "blue", "red"], 1)]
    rows += [("s2", "c", f"b{k}", "y z", v) for k, v in enumerate(["red", "blue", "green", "red"], 1)]
    claims = spark.createDataFrame(rows, SCHEMA)
    links = spark.createDataFrame([(f"p{k}", s, "c", f"{u}{k}") for k in (1, 2, 3) for s, u in (("s1", "a"), ("s2", "b"))], "pid string, site string, category string, url string")
    return claims, links


def test_probability_of_hand_computed_example(golden):
    claims, links = golden
    linked = claims.join(links, ["site", "category", "url"])
    pairs = M.candidates(linked)
    assert [(r.site1, r.site2, r.common) for r in pairs.collect()] == [("s1", "s2", 2)]
    row = M.probabilities(M.value_matches(pairs, linked), claims).first()
    assert row.matches == 3
    assert abs(row.prior - 0.648897) < 1e-6 and abs(row.log_odds + 0.834145) < 1e-6 and abs(row.p - 0.445233) < 1e-6
    assert M.edges(M.probabilities(M.value_matches(pairs, linked), claims), 0.5).count() == 0


def test_weights_of_matches(golden, spark):
    claims, links = golden
    more = claims.unionByName(spark.createDataFrame([("s2", "c", "b9", "y z", "red")], SCHEMA))
    linked = more.join(links.unionByName(spark.createDataFrame([("p1", "s2", "c", "b9")], links.schema)), ["site", "category", "url"])
    pairs = M.candidates(linked)
    for mode, want in (("no_minweight", 0.5), ("no", 0.5), ("yes", 1.0)):
        got = {(r.pid, r.w) for r in M.value_matches(pairs, linked, mode).collect()}
        assert ("p1", want) in got and ("p2", 1.0) in got


def test_head_and_tail(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([10, 5, 3, 1, 1])], "k int, n int")
    assert {r.k: r.part[0] for r in C.head_tail(rows, "n").collect()} == {0: "H", 1: "T", 2: "T", 3: "T", 4: "T"}


def test_metablocking_sums_scores(spark):
    rows = spark.createDataFrame([("b1", "g1", "x", 3), ("b1", "g2", "y", 3), ("b2", "g1", "x", 4), ("b2", "g2", "y", 4), ("b2", "g2", "z", 4), ("b2", "g1", "w", 4)], "b string, g string, i string, s int")
    found = {(r.i1, r.i2, r.score) for r in M.blocked_pairs(rows, "g", "i", "b", "s", 5).collect()}
    assert found == {("x", "y", 7)}


def test_frequent_core(spark):
    rows = [("s", "c", f"u{k}", n, "v") for k in range(3) for n in "abc"] + [("s", "c", "u9", "a", "v"), ("s", "c", "u8", "d", "v")]
    core = C.frequent_core(spark.createDataFrame(rows, SCHEMA), 3)
    assert sorted((r.url, r.name) for r in core.collect()) == sorted((f"u{k}", n) for k in range(3) for n in "abc")


def test_colons(spark):
    rows = spark.createDataFrame([("s", "c", "u", "info", "big one width: 3 cm height: 5"), ("s", "c", "v", "info", "plain")], SCHEMA)
    assert {(r.url, r.name, r.value) for r in C.split_colons(rows, ["width", "height"]).collect()} == {("u", "info", "big one"), ("u", "width", "3 cm"), ("u", "height", "5"), ("v", "info", "plain")}


def test_common_tokens_never_empty_a_value(spark):
    rows = spark.createDataFrame([("s", "c", f"u{k}", "n", v) for k, v in enumerate(["4 gb", "8 gb", "gb", "16 gb"])], SCHEMA)
    got = sorted(",".join(r.value) for r in C.transformed(rows, 0.5).collect())
    assert got == ["16.0", "4.0", "8.0", "gb"]


def test_mutual_information_formulas(spark):
    linked = spark.createDataFrame([("p1", "a1", "s1", "c", "n1", ["x", "y"]), ("p1", "b1", "s2", "c", "n2", ["x"]), ("p2", "a2", "s1", "c", "n1", ["y"]), ("p2", "b2", "s2", "c", "n2", ["z"])], "pid string, url string, site string, category string, name string, value array<string>")
    clustered = spark.createDataFrame([(0, "s1", "c", "n1"), (0, "s2", "c", "n2")], "cid long, site string, category string, name string")
    import math

    got = {r.token: r.mi for r in M.mutual_information(clustered, linked, reference=False).collect()}
    assert abs(got["x"] - math.log(2)) < 1e-9 and got["x"] > got["y"]


def test_pair_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 2), ("d", 2, 2)], "node string, cid int, real int")
    row = E.by_cells(rows, "node", "cid", "real").first()
    assert (row.tp, row.computed, row.expected, row.p, row.r, row.f) == (1, 3, 2, 0.333, 0.5, 0.4)
    none = E.by_cells(rows.filter("node = 'a'"), "node", "cid", "real").first()
    assert (none.p, none.r, none.f) == (-1.0, -1.0, -1.0)


def test_instance_level_counts_a_pair_once(spark):
    s = "site string, url string, name string, target string"
    expected = spark.createDataFrame([("s", "u", "a", "t1"), ("s", "v", "a", "t1"), ("s", "u", "a", "t2"), ("s", "v", "a", "t2"), ("s", "w", "b", "t1")], s)
    computed = spark.createDataFrame([("s", "u", "a", "k"), ("s", "v", "a", "k"), ("s", "x", "z", "k")], s)
    row = E.instance_level(computed, expected).first()
    assert (row.tp, row.computed, row.expected) == (1, 1, 1)


def test_page_linkage(spark):
    claims = spark.createDataFrame([("s1", "c", "a", "n", "rare"), ("s2", "c", "b", "m", "rare"), ("s1", "c", "a2", "n", "other"), ("s2", "c", "b2", "m", "thing")], SCHEMA)
    rare = L.rare_values(claims, claims.select("category", "value").limit(0))
    assert {(r.site, r.value) for r in rare.collect()} == {("s1", "rare"), ("s2", "rare")}
    pairs = L.page_candidates(L.blocks(claims, rare), 150)
    assert [(r.url1, r.url2, r.score) for r in pairs.collect()] == [("a", "b", 500)]
    clustered = spark.createDataFrame([(0, "s1", "c", "n"), (0, "s2", "c", "m")], "cid long, site string, category string, name string")
    p = L.page_probabilities(pairs, claims, clustered, prior=0.5).first().p
    f = 0.5  # of rare in both domains together
    e = 0.19
    odds = f * (1 - e * (1 - f)) / (f * f)
    assert abs(p - odds / (1 + odds)) < 1e-9
    links = spark.createDataFrame([("p", "s1", "c", "a"), ("p", "s2", "c", "b")], "pid string, site string, category string, url string")
    assert L.behave(pairs, links, "ADD").count() == 0 and L.behave(pairs, links, "DELETE").count() == 1
