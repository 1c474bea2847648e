from collections import defaultdict

from attrweave.llm import sharding
from tests.llm.cases import docs, hard


def shards(table, **options):
    out = defaultdict(list)
    for r in sharding.shard(table, **options).collect():
        out[r["shard"]].append(r)
    return out


def test_shards_are_ordered_and_even(spark):
    rows = [((k * 7919) % 100_003 - 50_000, "x" * (k * 31 % 211), "en", "s") for k in range(3_000)]
    total = sum(len(r[1]) for r in rows)
    found = shards(docs(spark, rows), shard_bytes=total // 12, tolerance=0.02)
    assert sum(map(len, found.values())) == len(rows) and len(found) == 13
    last = None
    for k in sorted(found):
        keys = [r.doc_id for r in found[k]]
        assert last is None or last < min(keys)
        last = max(keys)
        assert abs(sum(len(r.text) for r in found[k]) - total / 13) < 0.02 * total / 13 * 2 + 211


def test_a_partition_for_each_shard_sorted(spark):
    rows = [(k * 13 % 500, "text", "en", "s") for k in range(500)]
    parts = sharding.shard(docs(spark, rows), shard_bytes=400).rdd.mapPartitionsWithIndex(lambda k, it: [(k, [(r.doc_id, r["shard"]) for r in it])]).collect()
    for k, own in parts:
        assert [d for d, _ in own] == sorted(d for d, _ in own) and {s for _, s in own} <= {k}


def test_ties_stay_together(spark):
    rows = [(5, "x" * 100, "en", "s")] * 50 + [(6, "y", "en", "s")]
    found = shards(docs(spark, rows), shard_bytes=500)
    assert sorted(sorted({r.doc_id for r in own}) for own in found.values()) in ([[5], [6]], [[5, 6]])


def test_splitters_against_every_key(spark):
    """Each splitter is as near to its target as the tolerance asks, or as any key is."""
    rows = [(k * k % 9_973, "x" * (k * 31 % 211), "en", "s") for k in range(2_000)]
    total = sum(len(t) for _, t, _, _ in rows)
    sizes = spark.createDataFrame([(k, len(t)) for k, t, _, _ in rows], "key long, bytes long")
    below = lambda at: sum(len(t) for k, t, _, _ in rows if k < at)
    for shards in (2, 9, 40):
        cuts = sharding.splitters(sizes, -(-total // shards))
        count = -(-total // -(-total // shards))
        reach = {p: below(p) for p in {k for k, *_ in rows} | {k + 1 for k, *_ in rows}}
        for k in range(1, count):
            target, slack = total * k // count, sharding.TOLERANCE * total / count
            best = min(abs(v - target) for v in reach.values())
            assert min(abs(below(c) - target) for c in cuts) <= max(slack, best)


def test_the_default_size_splits_small_tables(spark):
    table = docs(spark, [(k, "x" * 2_000, "en", "s") for k in range(1_000)])
    sizes = {s: sum(len(r.text) for r in own) for s, own in shards(table).items()}
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * 250_000


def test_keys_are_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError):
        sharding.shard(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_edge_cases(spark):
    rows = hard("word " * 20_000)
    table = docs(spark, rows, extra=True)
    out = sharding.shard(table, shard_bytes=50)
    assert out.columns == [*table.columns, "shard_"] and out.count() == 9
    first = min(r["shard_"] for r in out.collect())
    assert {r["shard_"] for r in out.collect() if r.doc_id is None} == {first}
    assert sharding.shard(docs(spark, [])).count() == 0
    assert sharding.shard(docs(spark, [(2**63 - 1, "most", "en", "s"), (-(2**63), "least", "en", "s"), (0, "zero", "en", "s")]), shard_bytes=4).count() == 3


def test_bytes_below_are_exact(spark):
    import numpy as np

    sizes = spark.createDataFrame([(k % 40, k) for k in range(500)], "key long, bytes long")
    probes = np.array([-3, 0, 5, 39, 100])
    assert sharding._below(sizes, probes).tolist() == [sum(k for k in range(500) if k % 40 < p) for p in probes.tolist()]
