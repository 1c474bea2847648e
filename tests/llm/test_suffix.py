import random
from collections import defaultdict

import numpy as np

from attrweave.llm import suffix
from attrweave.llm.common import plain, unpack
from tests.llm.cases import docs, hard


def brute(rows, depth):
    """(doc_id, start) -> (kept, first doc_id) of every repeated window."""
    where = defaultdict(list)
    for doc, text in rows:
        words = [plain(w) for w in (text or "").split()]
        for k in range(len(words) - depth + 1):
            where[tuple(words[k : k + depth])].append((doc, k))
    out = {}
    for places in where.values():
        if len(places) > 1:
            for p in places:
                out[p] = (p == min(places), min(places)[0])
    return out


def found(spark, rows, depth, gram):
    out = {}
    for r in suffix.repeats(docs(spark, [(d, t, "en", "s") for d, t in rows]), depth, gram).collect():
        for k in range(r.start, r.stop + 1):
            assert (r.doc_id, k) not in out
            out[r.doc_id, k] = (r.kept, r.first_doc_id)
    return out


def corpus(seed, letters, n=40):
    rng = random.Random(seed)
    shared = [[rng.choice(letters) for _ in range(rng.randint(8, 30))] for _ in range(5)]
    rows = []
    for k in range(n):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((k, " ".join(words)))
    rows.append((n, rows[0][1]))
    return rows


def test_windows_against_brute_force(spark):
    many = ["w%d" % k for k in range(300)]
    for seed, letters, depth, gram in ((1, many, 8, 3), (2, ["a", "b", "c"], 10, 4), (3, ["a"], 6, 2), (4, ["A,", "a", "b."], 9, 1)):
        rows = corpus(seed, letters)
        assert found(spark, rows, depth, gram) == brute(rows, depth)


def test_many_batches_and_buckets(spark):
    rows = corpus(5, ["w%d" % k for k in range(40)], 300)
    table = docs(spark, [(d, t, "en", "s") for d, t in rows]).repartition(7)
    out = {(r.doc_id, k): (r.kept, r.first_doc_id) for r in suffix.repeats(table, 8, 2, batch_bytes=500, bucket_keys=50).collect() for k in range(r.start, r.stop + 1)}
    assert out == brute(rows, 8)


def test_a_popular_passage_goes_once_for_each_batch(spark):
    """10,000 documents share a passage: a bucket gets its windows once a batch, and its first occurrence alone stays."""
    passage = " ".join(f"p{k}" for k in range(60))
    table = spark.range(10_000).selectExpr("id as doc_id", f"concat('a', id, ' b', id, ' {passage} c', id) as text").repartition(8)
    spans = suffix.repeats(table, batch_bytes=200_000).groupBy("kept", "start", "stop", "first_doc_id").count().collect()
    assert {tuple(r) for r in spans} == {(True, 2, 12, 0, 1), (False, 2, 12, 0, 9_999)}
    number, ids = 4, np.arange(1_000)
    own = suffix.Batch(ids, ids, ids, np.zeros(1_000, int), np.full(1_000, 60), np.tile(np.arange(60), 1_000), np.arange(60).astype(np.uint64), np.add.outer(ids * 60, np.arange(11)).ravel())
    import pyarrow as pa

    sent = [x for b in suffix._owners([8, 24, 50], 1)(iter([pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own.body()])], names=["batch", "body"])])) for x in b.to_pylist()]
    assert len(sent) == 1 and len(unpack(sent[0]["body"])[2]) == 11


def test_repeats_inside_one_document(spark):
    rows = [(1, "x y z " * 10), (2, "p q r s t u v w p q r s t u v w"), (3, "none of this is twice here at all")]
    assert found(spark, rows, 6, 3) == brute(rows, 6)


def test_passages_join_windows(spark):
    passage = [f"p{k}" for k in range(60)]
    rows = [(7, ["a"] + passage + ["b"]), (3, passage + ["c"]), (5, [f"q{k}" for k in range(90)])]
    out = {(r.doc_id, r.start_word, r.stop_word, r.kept, r.first_doc_id) for r in suffix.passages(docs(spark, [(d, " ".join(w), "en", "s") for d, w in rows])).collect()}
    assert out == {(3, 0, 60, True, 3), (7, 1, 61, False, 3)}


def test_removal_leaves_the_first_occurrence(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    table = docs(spark, [(1, f"Before it.\n{passage} After.", "en", "s"), (2, f"Other start\n {passage}\nand end", "en", "s"), (3, passage, "en", "s"), (4, "clean words alone", "en", "s")], extra=True)
    out = suffix.remove_repeats(table)
    assert out.columns == table.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, f"Before it.\n{passage} After.", 74 - 74 + len(f"Before it.\n{passage} After.")), (2, "Other start\n and end", 20), (4, "clean words alone", 17)}


def test_edge_cases(spark):
    table = docs(spark, hard("word " * 3_000), extra=True)
    out = suffix.remove_repeats(table)
    assert out.columns == table.columns and out.count() == 9
    assert [r.text for r in out.collect() if r.doc_id == 4] == ["word"]  # one period
    assert suffix.passages(docs(spark, [])).count() == 0
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


def test_null_ids_come_first(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = {(r.doc_id, r.kept, r.first_doc_id) for r in suffix.passages(docs(spark, [(5, passage, "en", "s"), (None, passage + " x", "en", "s")])).collect()}
    assert rows == {(None, True, None), (5, False, None)}


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 2, 7, 8, 50):
        hashes = suffix.window_hashes(words, width)
        windows = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
        assert len(hashes) == len(windows) and len(set(hashes.tolist())) == len(set(windows))
