import numpy as np
import pytest

from attrweave.llm import hamming, simhash


def pairs_at(rng, distances):
    """Fingerprints k and n + k are distances[k] bits apart, all others far."""
    one = rng.integers(0, 2, (len(distances), 512))
    two = one.copy()
    for row, n in zip(two, distances):
        row[rng.choice(512, n, replace=False)] ^= 1
    return np.packbits(np.concatenate([one, two]).astype(np.uint8), axis=1)


def brute(prints):
    i, j = np.triu_indices(len(prints), 1)
    near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=int) <= simhash.MAX_DISTANCE
    return set(zip(i[near].tolist(), j[near].tolist()))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_parts_cover_the_ring_and_the_distance(radius):
    parts = hamming.parts(512, simhash.MAX_DISTANCE, radius)
    assert [p.start for p in parts] == np.cumsum([0, *[p.width for p in parts[:-1]]]).tolist() and sum(p.width for p in parts) == 512
    assert sum(p.radius + 1 for p in parts) == simhash.MAX_DISTANCE + 1


@pytest.mark.parametrize("radius,top", [(2, 0), (2, 1), (2, 3), (3, 0), (3, 2)])
def test_every_pair_of_different_labels_is_found(radius, top):
    rng = np.random.default_rng(11)
    prints = pairs_at(rng, [*range(60, 89), *[88] * 40, 0, 0])
    # A group of many rows that belong together, of which some are near rows with other labels.
    group = np.unpackbits(prints[:1], axis=1) ^ (rng.random((80, 512)) < 0.06)
    prints = np.concatenate([prints, np.packbits(group.astype(np.uint8), axis=1)])
    label = np.arange(len(prints))
    label[-70:] = len(prints)
    want = {(a, b) for a, b in brute(prints) if label[a] != label[b]}
    bits, found = np.unpackbits(prints, axis=1), set()
    for part in hamming.parts(512, simhash.MAX_DISTANCE, radius):
        key, one, two = hamming.keyed(bits, part)
        tile = key >> np.uint32(part.width - top)
        for u, v in hamming.tiles(part, top):
            rows = np.flatnonzero((tile == u) | (tile == v))
            for a, b in hamming.search(part, key[rows], one[rows], two[rows], label[rows], u ^ v, top):
                found |= {(int(min(x, y)), int(max(x, y))) for x, y in zip(rows[a], rows[b])}
    assert want <= found
    assert all(label[a] != label[b] for a, b in found)


def table(spark, prints):
    return spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(prints)], "doc_id long, fp binary")


def test_no_link_is_lost_at_the_edge_of_the_distance(spark):
    rng = np.random.default_rng(12)
    distances = np.repeat([80, 84, 86, 87, 88, 89], 50)
    roots = {r.node: r.root for r in simhash.groups(table(spark, pairs_at(rng, distances))).collect()}
    near = np.flatnonzero(distances <= simhash.MAX_DISTANCE).tolist()
    assert roots == {k: k for k in near} | {len(distances) + k: k for k in near}


def test_the_exact_search_alone_and_in_tiles(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(13)
    prints = pairs_at(rng, np.repeat([70, 88, 90], 30))
    labelled = table(spark, prints).withColumn("label", F.col("doc_id"))
    for held, wide in ((10**6, 10**6), (100, 10**6), (10**6, 0)):
        found = {(r.a, r.b) for r in simhash.last_links(labelled, len(prints), held, wide).collect()}
        assert found == brute(prints)


def test_more_bits_of_a_key_still_find_close_pairs(spark):
    rng = np.random.default_rng(14)
    prints = pairs_at(rng, [20] * 60)
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.first_links(table(spark, prints), 6).collect()}
    assert found == brute(prints)
