from pyspark.sql import functions as F

from attrweave.functions import numbers as N
from attrweave.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("s"))).collect()]


def test_fold(spark):
    assert one(spark, T.fold, "Écran: 15,6'' (LED)", "naïve—café 3.5x", "", None) == ["ecran 15,6 led", "naivecafe 3.5 x", "", None]


def test_keyvalues_and_urls(spark):
    assert one(spark, T.normalize_keyvalue, "  Screen \t Size:. ", ",;", None) == ["screen size", "", None]
    assert one(spark, T.normalize_url, "https://www.a.com//x//y/?q=1#z", "http://a.com", "a//b", "/1") == ["http://a.com/x/y?q=1", "http://a.com", "http:///a/b", "http:///1"]


def test_tokens_and_numbers(spark):
    assert one(spark, T.tokens, "14, mp front", "cannot 3.", "a b") == [["14", ",", "mp", "front"], ["can", "not", "3", "."], ["a", "b"]]
    assert one(spark, T.round_significant, "14.1", "14", "0", "1234", "1,25", "mp", "0.0567", None) == ["14.0", "14.0", "0", "1200.0", "1.2", "mp", "0.057", None]


def test_ngrams(spark):
    grams = one(spark, lambda s: T.ngrams(F.split(s, " "), 2), "a b c", "a")
    assert grams == [[["a", "b"], ["b", "c"]], []]


def test_weighted_jaccard(spark):
    row = spark.sql("select array('14.0','front','mp') a, array('14.0','mp') b, array() c").select(T.weighted_jaccard(F.col("a"), F.col("b")), T.weighted_containment(F.col("a"), F.col("b")), T.weighted_jaccard(F.col("a"), F.col("c").cast("array<string>"))).first()
    assert tuple(row) == (0.75, 1.0, 0.0)


def test_site_names_and_codes(spark):
    assert one(spark, T.short_site_name, "www.shop.co.uk", "m.a.example.com", "com") == ["shop", "example", "com"]
    assert one(spark, T.model_codes, "Sony DSC100 20MP and DSC100 x9") == [["DSC100", "x9"]]
    assert one(spark, T.numberless, "a12", "") == ["aBC", "NO_"]


def test_numbers(spark):
    row = spark.range(1).select(N.bayes(F.lit(0.5), F.lit(0.0)), N.bayes(F.lit(0.1), F.lit(60.0)), N.bayes(F.lit(0.9), F.lit(-60.0)), N.safe_divide(F.lit(1.0), F.lit(0.0)), N.significant(F.lit(0.123456)), N.f_measure(F.lit(0.0), F.lit(0.0)), N.f_measure(F.lit(-1.0), F.lit(0.5))).first()
    assert tuple(row) == (0.5, 1.0, 0.0, 0.0, 0.123, 0.0, -1.0)
