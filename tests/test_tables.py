from pyspark.sql import functions as F

from attrweave.operators import tables as X

SCHEMA = "site string, category string, url string, name string, value string"


def test_alignment_and_values(spark):
    claims = spark.createDataFrame([("a", "c", "u1", "n", "x"), ("a", "c", "u2", "m", "y"), ("b", "c", "v1", "n", "x")], SCHEMA)
    links = spark.createDataFrame([("p1", "a", "c", "u1"), ("p1", "b", "c", "v1"), ("p2", "a", "c", "u2")], "pid string, site string, category string, url string")
    rows = {r.pid: (r["a/n"], r["b/n"]) for r in X.alignment(claims, links, [("a", "n"), ("b", "n")]).collect()}
    assert rows == {"p1": ("x", "x"), "p2": ("NULL", "NULL")}
    values = {r.value: (r["a/n"], r["b/n"]) for r in X.value_table(claims, [("a", "n"), ("b", "n")]).collect()}
    assert values == {"x": (1, 1), "NULL": (1, 0)}
    kinds = X.link_triples(claims, links)
    assert kinds.count() == 2
    predicted = spark.createDataFrame([("p1", "n", "x"), ("p1", "n", "z"), ("p2", "n", "x")], "pid string, name string, value string")
    assert {r.kind: r.n for r in X.link_prediction(kinds, predicted).collect()} == {"known": 1, "ambiguous": 1, "inductable": 1}


def test_merge_prefers_fuller_rows(spark):
    a = spark.createDataFrame([("k", "1", ""), ("k", "1", "z")], "id string, x string, y string")
    b = spark.createDataFrame([("k", "w"), ("l", "q")], "id string, v string")
    assert sorted((r.id, r.x, r.y, r.v) for r in X.merged(a, b, "id").collect()) == [("k", "1", "z", "w"), ("l", None, None, "q")]


def test_small_ones(spark):
    titles = spark.createDataFrame([("a", "c", "u", "Sony DSC100 camera"), ("b", "c", "v", "camera dsc100"), ("b", "c", "w", "other q7")], "site string, category string, url string, title string")
    assert {(r.pid, r.url) for r in X.model_linkage(titles).collect()} == {("dsc100", "u"), ("dsc100", "v")}
    truth = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "b"), ("n3", "c")], "node string, target string")
    assert [(r.a, r.b) for r in X.targets_that_meet(truth).collect()] == [(["a", "b"], ["b"])]
    found = spark.createDataFrame([("x", "t", 1), ("y", "u", 1), ("x", "u", 2)], "name string, target string, place int")
    rows = {r.place: (r.tp, r.fp, r.fn, r.duplicated) for r in X.ontology(found, spark.createDataFrame([("x", "t"), ("y", "v")], "name string, target string")).collect()}
    assert rows == {1: (1, 1, 1, 0), 2: (1, 2, 1, 1)}
    assert spark.range(1).select(X.truth_row(F.lit("a"), F.lit("b"))).first()[0] == "a//b"
