"""The name baseline reads whole messages and keeps all turns apart."""

from attrweave.plans import queries


def test_all_words_and_turns_count(spark, tmp_path, monkeypatch):
    rows = [(1, 12, "user", "first  word\nlast"), (1, 10, "user", "again again")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    by_name = queries.K.by_name
    monkeypatch.setattr(queries.K, "by_name", lambda claims, **more: seen.append(claims) or by_name(claims, **more))
    queries.QUERIES["name_baseline"](spark, str(tmp_path))
    assert sorted((r.name, r.value) for r in seen[0].collect()) == [("turn10", "again"), ("turn12", "first"), ("turn12", "last"), ("turn12", "word")]
