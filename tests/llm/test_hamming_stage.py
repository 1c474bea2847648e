"""The pipeline's stage of near copies on texts at the edge of the distance."""

import numpy as np

import corpus_pipeline
from attrweave.llm import simhash
from tests.llm.cases import docs


def test_one_of_each_pair_at_the_edge_stays(spark):
    rng = np.random.default_rng(21)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(n)]
    texts = []
    for _ in range(300):
        one = words(100)
        texts += [" ".join(one), " ".join(one[:86] + words(14))]
    prints, _ = simhash.fingerprints(texts, simhash._Bits())
    apart = np.bitwise_count(prints[::2] ^ prints[1::2]).sum(axis=1, dtype=int)
    edge = np.flatnonzero((apart >= 84) & (apart <= 91))
    near = {int(k) for k in edge if apart[k] <= simhash.MAX_DISTANCE}
    assert len(near) > 50
    rows = [(2 * int(k) + c, texts[2 * int(k) + c], "en", "s") for k in edge for c in (0, 1)]
    left = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs(spark, rows), "").collect()}
    assert left == {r[0] for r in rows} - {2 * k + 1 for k in near}


def test_the_plan_is_the_same_at_any_size(spark, capsys):
    left = corpus_pipeline.near_copy_stage(spark, docs(spark, [(1, "one text", "en", "s"), (2, "one text", "en", "s")]), "")
    assert [r.doc_id for r in left.collect()] == [1]
    left.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan.split("LeftAnti")[0] and "SortMergeJoin" in plan.split("LeftAnti")[0]


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(n)]


def stay(spark, rows, extra=False):
    """(doc_id, source) of the rows (doc_id, text, source) that the stage leaves."""
    table = docs(spark, [(k, text, "en", source) for k, text, source in rows], extra)
    left = corpus_pipeline.near_copy_stage(spark, table, "")
    assert left.columns == table.columns
    return sorted(((r.doc_id, r.source) for r in left.collect()), key=str)


def test_texts_without_an_id_are_near_copies_too(spark):
    rng = np.random.default_rng(22)
    one, two = words(rng, 100), words(rng, 100)
    near, one, two = " ".join(one[:97] + words(rng, 3)), " ".join(one), " ".join(two)
    assert stay(spark, [(None, near, "a"), (7, one, "b")]) == [(7, "b")]
    left = stay(spark, [(None, near, "a"), (None, one, "a"), (None, two, "b"), (None, None, "c"), (None, "", "c")])
    assert left == [(None, "a"), (None, "b"), (None, "c"), (None, "c")]


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    rng = np.random.default_rng(23)
    one, two, three = words(rng, 100), words(rng, 100), words(rng, 100)
    near, one, two, three = " ".join(one[:97] + words(rng, 3)), " ".join(one), " ".join(two), " ".join(three)
    # The texts of 5 are near copies of 1 and 2, which have nothing in common, and one of its own.
    rows = [(1, one, "a"), (2, two, "b"), (5, near, "c"), (5, two, "d"), (5, three, "e")]
    assert stay(spark, rows) == [(1, "a"), (2, "b"), (5, "e")]
    assert len(stay(spark, [(1, one, "a"), (1, near, "b")])) == 1


def test_of_repeated_rows_one_stays(spark):
    rng = np.random.default_rng(24)
    one, two = " ".join(words(rng, 100)), " ".join(words(rng, 100))
    left = stay(spark, [(1, one, "a"), (1, one, "a"), (1, one, "a"), (3, one, "c"), (None, two, "d"), (None, two, "d"), (4, None, "e"), (4, None, "e")], extra=True)
    assert left == [(1, "a"), (4, "e"), (4, "e"), (None, "d")]
