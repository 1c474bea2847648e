from attrweave.operators import tagging as G


def test_the_two_taggers(spark):
    known = spark.createDataFrame([("a b", [1]), ("b c", [2]), ("b", [3]), ("d", [4])], "value string, clusters array<long>")
    values = spark.createDataFrame([("a b c d", None), ("a b c d", 4)], "value string, own long")
    every = {(r.own, r.gram) for r in G.tag_all(values, known).collect()}
    assert every == {(None, g) for g in ("a b", "b c", "b", "d")} | {(4, g) for g in ("a b", "b c", "b")}
    longest = {(r.own, r.gram, r.cluster) for r in G.tag_longest(values, known).collect()}
    assert longest == {(None, "a b", 1), (None, "d", 4), (4, "a b", 1)}


def test_a_gram_of_the_own_and_another_cluster():
    assert G.longest_first("x y".split(), {"x": (1, 2), "y": (1,)}, 1) == [("x", (2,))]


def test_virtual_claims_and_their_filter(spark):
    rows = [("s", "c", f"u{k}", "spec", v, None) for k, v in enumerate(["red big", "blue big", "green small", "red"])]
    claims = spark.createDataFrame(rows, "site string, category string, url string, name string, value string, own long")
    known = spark.createDataFrame([(v, [1]) for v in ("red", "blue", "green")] + [(v, [2]) for v in ("big", "small")], "value string, clusters array<long>")
    tags = G.tag_longest(claims.select("value", "own"), known)
    virtual = G.virtual_claims(claims, tags)
    assert {(r.url, r.name, r.value) for r in virtual.collect()} >= {("u0", "spec#-#1", "red"), ("u2", "spec#-#2", "small")}
    kept = G.filter_virtual(virtual, claims, known, ratio=0.5, least=2, score=1.0)
    assert {r.name for r in kept.collect()} == {"spec#-#1", "spec#-#2"}
    assert G.filter_virtual(virtual, claims, known, score=2.5).select("name").distinct().count() == 1


def test_clear_output(spark):
    nodes = spark.createDataFrame([("a", "a"), ("a#-#1", "a"), ("b", "b"), ("c#-#2", "c"), ("c", "c")], "node string, orig string")
    clustered = spark.createDataFrame([(0, "a"), (0, "a#-#1"), (0, "b"), (1, "c#-#2")], "cid long, node string")
    # The original of c#-#2 is isolated, so its cluster says something new.
    assert {(r.cid, r.node) for r in G.clear_output(clustered, nodes).collect()} == {(0, "a"), (0, "b"), (1, "c#-#2")}
    elsewhere = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a#-#1")], "cid long, node string")
    assert {(r.cid, r.node) for r in G.clear_output(elsewhere, nodes).collect()} == {(0, "a"), (0, "b")}
    virtual = spark.createDataFrame([("c#-#2", "c"), ("c#-#3", "c"), ("b", "b"), ("c", "c")], "node string, orig string")
    urls = spark.createDataFrame([("c#-#2", "u1"), ("c#-#3", "u1"), ("c#-#3", "u2"), ("b", "u3")], "node string, url string")
    both = spark.createDataFrame([(0, "c#-#2"), (0, "c#-#3"), (0, "b")], "cid long, node string")
    assert {(r.cid, r.node) for r in G.clear_output(both, virtual, urls).collect()} == {(0, "c#-#3"), (0, "b")}


def test_snippets_are_shared_out():
    found = {1: {"a", "b"}, 2: {"a"}, 3: {"b", "c"}}
    assert G.shared_out(found, False) == [(2, "a"), (1, "a b"), (3, "b c")]
    assert G.shared_out(found, True) == [(2, "a"), (1, "b"), (3, "c")]
