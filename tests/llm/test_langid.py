from attrweave.llm import langid
from tests.llm.cases import docs, hard


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    model = langid.fit([(r.text, r.lang) for r in rows if r.doc_id % 2])
    held = spark.createDataFrame([(r.doc_id, r.text) for r in rows if r.doc_id % 2 == 0], "doc_id long, text string")
    truth = {r.doc_id: r.lang for r in rows}
    found = langid.identify(held, model).collect()
    assert sum(r.language == truth[r.doc_id] for r in found) > 0.98 * len(found)
    assert sum(r.accepted for r in found) > 0.98 * len(found)


def test_scores_are_those_of_the_counts():
    model = langid.fit([("aba aba", "x"), ("bcb bcb", "y")])
    totals, grams = langid.score(model, ["aba", "", "z", "abab"])
    for text, total, n in zip(["aba", "", "z", "abab"], totals, grams):
        codes, lengths = langid._codes([text])
        ids = [int(b) for _, own in langid._grams(codes, lengths) for b in own if b < 1 << langid.BITS]
        assert n == len(ids)
        assert abs(total - model.logs[ids].sum(axis=0)).max() < 1e-3 if ids else not total.any()


def test_edge_cases(spark):
    table = docs(spark, hard("the words of a language " * 20_000), extra=True)
    model = langid.fit([("the words of a language and a text of some plain words", "en"), ("les mots de la langue", "fr")])
    found = langid.identify(table, model)
    rows = found.collect()
    assert len(rows) == 9
    assert {r.accepted for r in rows if r.language is None} == {False}
    kept = langid.filter_languages(table, model)
    assert kept.columns == table.columns
    assert kept.count() == sum(r.accepted for r in rows) and kept.filter("text is null").count() == 0
    assert langid.filter_languages(table, model, languages=["fr"]).count() == 0


def test_without_labels_and_without_rows(spark):
    unlabelled = docs(spark, [(1, "words", None, "s")])
    assert not any(r.accepted for r in langid.identify(unlabelled).collect())
    assert langid.identify(docs(spark, [])).count() == 0
    assert langid.filter_languages(docs(spark, [])).count() == 0
