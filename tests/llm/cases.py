"""Documents for the operators' edge cases: nulls, ties, repeated rows, long texts, extra columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("shard", "copy", "batch", "places", "body", "fp", "tag", "digit", "key", "bytes", "share", "p", "q", "host", "root", "node")


def docs(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """rows: (doc_id, text, lang, source)."""
    table = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    if extra:
        for name in CLASHING:
            table = table.selectExpr("*", f"1 AS `{name}`")
    return table


def hard(long_text: str) -> list[tuple]:
    """Rows with every hard case."""
    return [(1, "a text of some plain words", "en", "s1"), (1, "a text of some plain words", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (None, "words without an id, these", "en", "s2"), (None, None, None, None), (4, long_text, "en", "s2"), (5, " \n\t ", "en", "s2"), (1, "another text under the first id", "en", "s1")]
