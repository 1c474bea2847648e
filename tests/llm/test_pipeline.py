"""The pipeline's stages against what they are made for, and the registered queries."""

import __spark_entry__
import corpus_pipeline
from tests.llm.cases import docs


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_in_order_and_their_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "/root/testdata/sf0.001")
        assert rows.columns == table.columns


def test_run_against_its_parts(spark):
    import tiktoken

    from attrweave.llm import bpe

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: (r.ids, r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, sf).collect()}
    assert rows and all(trip and len(ids) == n for ids, n, trip in rows.values())
    # Each document that is left decodes to its own text, less passages that others have before it.
    codec = bpe.Codec.load()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for doc, (ids, _, _) in rows.items():
        text = codec.decode(ids)
        assert ids == reference.encode_ordinary(text)
        left = iter(texts[doc].split())
        assert all(w in left for w in text.split())


def test_planted_cases(spark):
    import random

    rng = random.Random(9)
    words = lambda n: [rng.choice("the of and to in is for on that with was".split()) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    base = [words(200) for _ in range(30)]
    rows = [(k, " ".join(b), "en", f"s{k % 3}") for k, b in enumerate(base)]
    rows += [(100 + k, " ".join(base[k]), "en", "s0") for k in range(5)]  # exact copies
    for k in range(5, 10):  # near copies
        copy = list(base[k])
        for at in rng.sample(range(200), 6):
            copy[at] = words(1)[0]
        rows.append((100 + k, " ".join(copy), "en", "s1"))
    passage = words(70)
    rows += [(200 + k, " ".join(words(100) + passage + words(100)), "en", "s2") for k in range(4)]
    rows += [(300, "0101 1110 0001 1001 0110 " * 40, None, "s0"), (301, None, None, None), (302, "", "en", "s1")]
    table = docs(spark, rows)
    told = corpus_pipeline.language_stage(spark, table, "")
    left = {r.doc_id for r in told.collect()}
    assert left >= {r[0] for r in rows if r[0] < 300} and not left & {301, 302}
    apart = corpus_pipeline.near_copy_stage(spark, told, "")
    assert {r.doc_id for r in apart.collect() if r.doc_id < 300} == set(range(30)) | set(range(200, 204))
    once = corpus_pipeline.repeat_stage(spark, apart, "")
    joined = " ".join(passage)
    assert sorted(r.doc_id for r in once.collect() if joined in (r.text or "")) == [200]
    assert {r.doc_id: r.text for r in once.collect() if r.doc_id < 30} == {k: " ".join(b) for k, b in enumerate(base)}


def test_stages_on_hard_rows_and_none(spark):
    from tests.llm.cases import hard

    rows = hard("the long words of a text that goes on and on " * 4_000) + [(k, "the words of the text that it is made of, and more of them " * 3, "en", "s3") for k in range(10, 14)]
    for table in (docs(spark, rows, extra=True), docs(spark, []), docs(spark, [], extra=True)):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, "")
            assert left.columns == table.columns
            left.count()
        tokens = corpus_pipeline.STAGES[-1][1](spark, left, "").collect()
        assert all(r.round_trip for r in tokens)


def test_mixing_keeps_a_column_named_copy(spark):
    table = docs(spark, [(k, f"text number {k}", "en", "s") for k in range(6)]).selectExpr("*", "doc_id * 2 AS copy")
    mixed = corpus_pipeline.mixing_stage(spark, table, "")
    assert mixed.columns == table.columns
    rows = mixed.collect()
    assert rows and all(r.copy == 2 * r.doc_id for r in rows)
