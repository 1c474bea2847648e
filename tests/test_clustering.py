import random

from attrweave.operators import clustering as K
from attrweave.operators.shared import components


def reference(edges, sources, urls, masters, rule):
    """Greedy clustering on one machine, over all edges at once."""
    of, members = {}, {}
    for k, (x, y, _) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1]), reverse=True)):
        a, b = of.get(x), of.get(y)
        if a is not None and a == b:
            continue
        left, right = members.get(a, {x}), members.get(b, {y})
        if rule == "source" and {sources[n] for n in left} & {sources[n] for n in right}:
            continue
        if rule == "same_page" and ({u for n in left for u in urls[n]} & {u for n in right for u in urls[n]} or sum(n in masters for n in left | right) > 1):
            continue
        new = min([c for c in (a, b) if c is not None], default=k)
        for c in (a, b):
            members.pop(c, None)
        members[new] = left | right
        for n in members[new]:
            of[n] = new
    order = {c: i for i, c in enumerate(sorted(members))}
    return {n: order[c] for n, c in of.items()}


def test_by_component_as_over_all(spark):
    rng = random.Random(3)
    for rule in ("same_page", "source", "free"):
        names = [f"n{k:02d}" for k in range(36)]
        sources = {n: f"s{rng.randrange(6)}" for n in names}
        urls = {n: [f"u{rng.randrange(40)}" for _ in range(2)] for n in names}
        masters = {n for n in names if sources[n] == "s0"} if rule == "same_page" else set()
        edges = {}
        for _ in range(34):
            x, y = sorted(rng.sample(names, 2))
            edges[x, y] = rng.choice([0.5, 0.7, 0.7, 0.9, 1.0])
        rows = [(x, y, w) for (x, y), w in edges.items()]
        nodes = spark.createDataFrame([(n, sources[n], n in masters, urls[n]) for n in names], "node string, source string, master boolean, urls array<string>")
        found = {r.node: r.cid for r in K.cluster(spark.createDataFrame(rows, "n1 string, n2 string, weight double"), nodes, rule).collect()}
        want = reference(rows, sources, urls, masters, rule)
        groups = lambda m: {frozenset(n for n in m if m[n] == c) for c in m.values()}
        assert groups(found) == groups(want)
        if rule != "free":
            assert found == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "n1 long, n2 long")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(spark.createDataFrame([], "n1 long, n2 long")).count() == 0


def test_names_and_comparison(spark):
    clustered = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e")], "cid long, node string")
    names = spark.createDataFrame([("a", "size"), ("b", "size"), ("c", "width#-#1"), ("d", "z"), ("e", "y")], "node string, name string")
    assert {r.cid: r.label for r in K.name_of(clustered, names).collect()} == {0: "size", 1: "y"}
    assert {r.cid: r.names for r in K.top_names(clustered, names).collect()} == {0: ["size", "width"], 1: ["y", "z"]}
    other = spark.createDataFrame([(5, "a"), (5, "b"), (6, "c"), (7, "d"), (7, "e")], "cid long, node string")
    row = K.evolution(clustered, other).first()
    assert (row.kept, row.added, row.deleted) == (2, 0, 2)
    assert K.same_clusters(clustered, other) == 1 / 4 and K.paired_overlap(clustered, other) == 4 / 5


def test_aggregate_keeps_old_pairs(spark):
    old = spark.createDataFrame([(0, "a"), (0, "b")], "cid long, node string")
    nodes = spark.createDataFrame([(n, n, False, [n]) for n in "abc"], "node string, source string, master boolean, urls array<string>")
    edges = spark.createDataFrame([("b", "c", 0.1)], "n1 string, n2 string, weight double")
    assert {r.node for r in K.aggregate(old, edges, nodes, "same_page", 0.9).collect()} == {"a", "b", "c"}
