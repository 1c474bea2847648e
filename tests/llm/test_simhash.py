import numpy as np
import pyarrow as pa

from attrweave.llm import simhash
from tests.llm.cases import docs, hard


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_fingerprint_is_the_sign_of_the_sum():
    bits = simhash._Bits()
    text = "Some words, some WORDS and others " + " ".join(f"w{k}" for k in range(700))
    prints, found = simhash.fingerprints([text, "", None, "some"], bits)
    assert found.tolist() == [True, False, False, True]
    hashes = np.unique(simhash.WordIds().of(text.split()))
    sums = np.unpackbits(simhash._expand(hashes), axis=1).sum(axis=0, dtype=np.int64)
    assert (prints[0] == np.packbits(2 * sums > len(hashes))).all()


def test_fingerprints_after_the_memory_is_full():
    small = simhash._Bits()
    small.words.most = 50
    rng = np.random.default_rng(1)
    texts = [" ".join(words(rng, 60)) for _ in range(8)]
    assert (simhash.fingerprints(texts, small)[0] == simhash.fingerprints(texts, simhash._Bits())[0]).all()


def near_prints(rng, groups, copies):
    base = rng.integers(0, 2, (groups, 512))
    out = []
    for row in base:
        for _ in range(copies):
            flips = rng.random(512) < rng.uniform(0.01, 0.09)
            out.append(row ^ flips)
    return np.packbits(np.array(out, dtype=np.uint8), axis=1)


def test_recall_of_pairs_against_brute_force():
    rng = np.random.default_rng(2)
    prints = near_prints(rng, 120, 4)
    bits = np.unpackbits(prints, axis=1).astype(np.int32)
    apart = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    true = {(i, j) for i in range(len(bits)) for j in range(i) if apart[i, j] <= simhash.MAX_DISTANCE}
    raw = pa.array([p.tobytes() for p in prints], pa.binary())
    keyed = pa.Table.from_batches(list(simhash._keyed(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(prints))), raw], names=["doc_id", "fp"])]))))
    live = pa.Table.from_batches(list(simhash._partnered(iter(keyed.sort_by("chain").combine_chunks().to_batches(max_chunksize=997)))))
    rows = live.append_column("fp", raw.take(live.column("doc_id")))
    batches = rows.sort_by("chain").combine_chunks().to_batches(max_chunksize=997)
    found = {(max(a, b), min(a, b)) for r in simhash._linked(iter(batches)) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
    assert found <= true
    assert len(found) >= 0.9 * len(true)


def test_large_buckets_connect_the_same():
    rng = np.random.default_rng(3)
    prints = near_prints(rng, 3, 60)
    wide = np.ascontiguousarray(prints).view(np.uint64)
    a, b = simhash._forest(wide, np.zeros(len(prints), dtype=np.int64))
    i, j = np.triu_indices(len(prints), 1)
    near = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= simhash.MAX_DISTANCE

    def groups(pairs):
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        return {frozenset(k for k in range(len(prints)) if find(k) == r) for r in map(find, range(len(prints)))}

    assert groups(zip(a.tolist(), b.tolist())) == groups(zip(i[near].tolist(), j[near].tolist()))


def test_groups_keep_their_least_document(spark):
    rng = np.random.default_rng(4)
    rows, of = [], {}
    for g in range(40):
        base = words(rng, 150)
        for c in range(4):
            text = list(base)
            for k in rng.choice(150, 0 if c == 1 else 3 * c, replace=False):
                text[k] = words(rng, 1)[0]
            doc = 1000 - (4 * g + c)
            rows.append((doc, " ".join(text), "en", "s"))
            of[doc] = 1000 - (4 * g + 3)
    rows += [(5000 + k, " ".join(words(rng, 100)), "en", "s") for k in range(50)]
    gone = {r.doc_id: r.kept_doc_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert gone == {d: k for d, k in of.items() if d != k}
    kept = {r.doc_id for r in simhash.drop_copies(docs(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - gone.keys()


def test_edge_cases(spark):
    table = docs(spark, [*hard("word " * 50_000), (9, "a text of some plain words", "en", "s9")], extra=True)
    kept = simhash.drop_copies(table)
    assert kept.columns == table.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 1, 1, 2, 3, 4, 5]
    assert sum(r.doc_id is None for r in rows) == 2
    assert simhash.near_copies(docs(spark, [])).count() == 0
    assert simhash.drop_copies(docs(spark, [])).count() == 0


def test_recall_of_pairs_at_the_edge_of_the_distance():
    rng = np.random.default_rng(6)
    apart = np.repeat(np.arange(80, simhash.MAX_DISTANCE + 1), 150)
    one = rng.integers(0, 2, (len(apart), 512))
    two = one.copy()
    for row, n in zip(two, apart):
        row[rng.choice(512, n, replace=False)] ^= 1
    prints = np.packbits(np.concatenate([one, two]).astype(np.uint8), axis=1)
    raw = pa.array([p.tobytes() for p in prints], pa.binary())
    keyed = pa.Table.from_batches(list(simhash._keyed(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(prints))), raw], names=["doc_id", "fp"])]))))
    live = pa.Table.from_batches(list(simhash._partnered(iter(keyed.sort_by("chain").combine_chunks().to_batches(max_chunksize=9_973)))))
    rows = live.append_column("fp", raw.take(live.column("doc_id")))
    found = {(min(a, b), max(a, b)) for r in simhash._linked(iter(rows.sort_by("chain").combine_chunks().to_batches(max_chunksize=997))) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}
    assert found <= {(k, k + len(apart)) for k in range(len(apart))}
    by = [sum((k, k + len(apart)) in found for k in np.flatnonzero(apart == d)) / 150 for d in range(80, simhash.MAX_DISTANCE + 1)]
    print([round(float(x), 3) for x in by])
    assert len(found) >= 0.9 * len(apart)
