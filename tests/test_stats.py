"""Copies and linkages against the reference's examples and brute force."""

import random

from attrweave.operators import stats as A

CLAIMS = "site string, category string, url string, name string, value string"


def table(spark, pages):
    """pages: {(site, url): {name: value}}."""
    return spark.createDataFrame([(s, "c", u, n, v) for (s, u), spec in pages.items() for n, v in spec.items()], CLAIMS)


def found(df):
    return {((r.site1, r.url1), (r.site2, r.url2)): (r.shared, r.ratio) for r in df.collect()}


def brute(pages, least_shared, ratio):
    out, keys = {}, sorted(pages)
    for i, p in enumerate(keys):
        for q in keys[i + 1 :]:
            a, b = set(pages[p].items()), set(pages[q].items())
            if len(a & b) >= least_shared and len(a & b) / max(len(a), len(b)) > ratio:
                out[p, q] = (len(a & b), round(len(a & b) / max(len(a), len(b)), 6))
    return out


def spec(*names, **more):
    return {str(n): "100" for n in names} | more


REFERENCE = {("s1", "u11"): spec(1, 2, 3), ("s1", "u12"): spec(1, 2, 3), ("s1", "u13"): spec(5, 6, 7), ("s1", "u14"): spec(8, 9, 10), ("s2", "u21"): spec(1, 2, 3), ("s2", "u22"): spec(1, 2, 3) | {"4": "50"}, ("s2", "u23"): spec(5, 6, 7)}


def test_page_copies_of_the_reference(spark):
    pairs = {(p[1], q[1]) for p, q in found(A.page_copies(table(spark, REFERENCE), ratio=0.7))}
    assert pairs == {("u11", "u12"), ("u11", "u21"), ("u11", "u22"), ("u12", "u21"), ("u12", "u22"), ("u13", "u23"), ("u21", "u22")}


def test_popular_claims_count_for_copies(spark):
    pages = {("s", f"u{k:03}"): {f"a{j}": "common" for j in range(7)} | {f"r{j}": f"own {k}" for j in range(3)} for k in range(120)}
    pages["t", "copy"] = dict(pages["s", "u005"])  # 3 rare and 7 popular claims
    pages["t", "popular"] = {f"a{j}": "common" for j in range(7)}
    pages["t", "again"] = {f"a{j}": "COMMON" for j in range(7)} | {"<page title>": "a title"}
    assert found(A.page_copies(table(spark, pages))) == {(("s", "u005"), ("t", "copy")): (10, 1.0), (("t", "again"), ("t", "popular")): (7, 1.0)}


def test_page_copies_against_brute_force(spark):
    rng = random.Random(5)
    base = [{f"n{j}": str(rng.randint(0, 2)) for j in range(rng.randint(2, 14))} for _ in range(25)]
    pages = {}
    for k in range(90):
        own = dict(rng.choice(base))
        for n in rng.sample(sorted(own), rng.randint(0, 2)):
            own[n] = str(rng.randint(0, 2))
        pages[f"s{k % 4}", f"u{k}"] = own
    for least, ratio in ((3, 0.9), (3, 0.7), (1, 0.5), (2, 0.8)):
        want = brute(pages, least, ratio)
        assert len(want) > 10 and found(A.page_copies(table(spark, pages), least, ratio)) == want


def test_linkages_by_key_at_a_larger_size(spark):
    from attrweave.plans import queries

    rows = queries.QUERIES["key_linkages"](spark, "/root/testdata/sf0.1").collect()
    assert rows and all((r.site1, r.site2) == ("customer", "orders") and r.score > 0.1 for r in rows)
