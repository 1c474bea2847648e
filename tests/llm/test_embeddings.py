import numpy as np
import pytest

from attrweave.llm import embeddings


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def brute(rows, threshold):
    """id -> (class, links)."""
    rows = list({(a, None if u is None else tuple(u)): (a, u) for a, u, _ in rows if a is not None}.values())
    links, root = dict.fromkeys((a for a, _ in rows), 0), {a: a for a, _ in rows}
    for k, (a, u) in enumerate(rows):
        for b, v in rows[:k]:
            if a == b or u is None or v is None or len(u) != len(v) or None in u or None in v:
                continue
            x, y = np.array(u, dtype=np.float32).astype(float), np.array(v, dtype=np.float32).astype(float)
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if not np.isfinite(n) or n == 0 or x @ y / n < threshold:
                continue
            links[a] += 1
            links[b] += 1
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return {a: (root[a], links[a]) for a in links}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {a: (c, n) for a, c, n in rows}


def vectors(seed, n, dimension=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dimension))
    return [(k, (base[k % len(base)] + rng.standard_normal(dimension) * rng.choice([0, 0.05, 0.3, 0.6])).tolist(), 0) for k in range(n)]


@pytest.mark.parametrize(("size", "least"), [(1 << 20, 400), (1 << 20, 50), (960, 64), (720, 10_000)])
def test_classes_and_links_against_brute_force(spark, size, least):
    rows = vectors(1, 240)
    for threshold in (0.95, 0.6):
        assert found(embeddings.near_copies(table(spark, rows), threshold=threshold, tile_bytes=size, least=least)) == brute(rows, threshold)


def test_a_group_of_a_third_of_all_rows(spark):
    """Its pairs are counted, not emitted: what the tasks return is a few rows for each vector and pair of tiles."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(k, (base if k % 6 == 0 else base + rng.standard_normal(16) * 0.01 if k % 6 == 3 else rng.standard_normal(16)).tolist(), 0) for k in range(1_500)]
    out = found(embeddings.near_copies(table(spark, rows), least=200))
    assert {k for k, (c, n) in out.items() if (c, n) == (0, 499)} == set(range(0, 1_500, 3))


def test_pairs_in_doubt_are_computed_again(spark):
    """Vectors whose similarity is within the bound of the threshold, on either side."""
    rows, angle = [], np.arccos(0.95)
    for k in range(60):
        for j, off in enumerate((-1e-4, 1e-4)):
            turn = k * 2.0
            u = np.zeros(8)
            u[:2], u[2 + k % 6] = (np.cos(turn), np.sin(turn)), 0.3
            v = u.copy()
            v[:2] = np.cos(turn + angle + off), np.sin(turn + angle + off)
            rows += [(4 * k + 2 * j, u.tolist(), 0), (4 * k + 2 * j + 1, v.tolist(), 0)]
    threshold = 0.95
    assert found(embeddings.near_copies(table(spark, rows), threshold=threshold, least=50)) == brute(rows, threshold)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    units = embeddings.unit(rng.standard_normal((300, 40)) * rng.uniform(1e-20, 1e20, (300, 1)))
    q, s, e = embeddings.quantise(units)
    exact = units @ units.T
    whole = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    bound = e[:, None] * (1 + e)[None, :] + e[None, :] * (1 + e)[:, None] + e[:, None] * e[None, :]
    assert (np.abs(exact - whole) <= bound + 1e-12).all()


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0), (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.9999, 0.01], 1), (8, [], 0), (9, [float("inf"), 0.0], 0), (10, [1e-30, 0.0], 0)]
    want = {1: (1, 4), 2: (1, 3), 10: (1, 3)} | {k: (k, 0) for k in (3, 4, 5, 6, 7, 8, 9)}
    extra = table(spark, rows).selectExpr("*", "1 AS id", "2 AS home", "3 AS v", "4 AS hash", "5 AS part", "6 AS links", "7 AS class_id")
    assert found(embeddings.near_copies(extra)) == want
    assert embeddings.near_copies(table(spark, [])).count() == 0
    assert found(embeddings.near_copies(table(spark, rows, "double"))) == want
