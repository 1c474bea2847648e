"""Mixing sources to target weights by Pareto order sampling.

Each source is to have its weight's share of `total` copies. Inside a source a document's expected copies are
proportional to its measure, the number of binary digits of its length in characters. The whole part of its
expectation are certain copies; what is left of it is its odds in a Pareto sample: with u, uniform by a hash of seed and
document, and p, its inclusion probability, documents are ranked by (u / (1 - u)) / (p / (1 - p)) and the first k of a
source get one copy more, k being what its size has beyond the certain copies. Sizes are whole numbers that add up to
`total`: shares are rounded down, and the largest remainders, of equal ones the first by source, get one more.

The k-th rank is found without sorting a source: counts by source and logarithmic bucket of ranks give the bucket of
the k-th; only its rows are ordered. The decision is then local
to a row: documents are never exchanged.

Edge cases: null source: a source of its own; a null text has length 0; a source whose weight is 0 or missing gives
nothing; rows that agree in doc_id and length have the same u and are ordered by doc_id, length and text, so of ties the
first by text get the copy, and rows alike in all of these share one decision: they all get it or, when fewer places
are left than they are, so many of them as there are places; an empty table gives an empty table; a weight for a source
that doesn't occur is left out and the others are scaled to 1; all columns come back as they were, with `copy` (1 for
the first) added by mix(), named with an underscore behind it while docs have a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrweave.llm.common import free_name, text_of, written

SEED = 20_240
#: Buckets of ranks for each power of two.
BUCKETS = 256
#: Sources up to which their figures are sent to every task; beyond, they are joined.
MOST_LITERAL = 20_000


def _measure(length: Column) -> Column:
    return F.length(F.bin(length)).cast("long")


def _uniform(seed: int, doc: Column, length: Column) -> Column:
    """In (0, 1): the first 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")), length.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Columns __aw_source (null as its own value), __aw_doc, __aw_length, __aw_x, __aw_u of each row."""
    length = F.length(text_of(docs)).cast("long")
    source = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    return docs.select(source.alias("__aw_source"), F.col("doc_id").alias("__aw_doc"), length.alias("__aw_length"), _measure(length).alias("__aw_x"), _uniform(seed, F.col("doc_id"), length).alias("__aw_u"))


def _expected(x: Column, share: Column, sum_x: Column) -> Column:
    return share * x / sum_x


def _rank(u: Column, p: Column) -> Column:
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _with(rows: DataFrame, figures: DataFrame, count: int, names: list[str]) -> DataFrame:
    """rows joined with the figures of their source: as a map literal where the sources are few, else by a join."""
    if count > MOST_LITERAL:
        return rows.join(figures, "__aw_source")
    found = figures.select("__aw_source", *names).collect()
    small = rows.sparkSession.createDataFrame(found, figures.select("__aw_source", *names).schema)
    return rows.join(F.broadcast(small), "__aw_source")


def _sizes(wanted: DataFrame, count: int, weight_sum: float, total: int) -> DataFrame:
    """Columns __aw_source, sum_x, share, size: the part of the total, and the whole number of copies, of each source."""
    share = F.col("weight") / F.lit(weight_sum) * F.lit(float(total))
    parts = wanted.select("__aw_source", "sum_x", share.alias("share"), F.floor(share).cast("long").alias("least"), (share - F.floor(share)).alias("left"))
    more = total - (parts.agg(F.sum("least")).first()[0] or 0)
    by = [F.desc("left"), F.asc("__aw_source")]
    if count <= MOST_LITERAL:
        ranked = parts.withColumn("at", F.row_number().over(Window.orderBy(*by)))
    else:
        # The rank is counted by sorted ranges, so no task has all sources.
        ranges = written(parts.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "mixing-ranges")
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = ranges.join(F.broadcast(starts), "range").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*by)))
    return ranked.select("__aw_source", "sum_x", "share", (F.col("least") + (F.col("at") <= more).cast("long")).alias("size"))


def plan(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """Columns __aw_source, share, sum_x, cut, ties of each source, and how many sources there are.

    share: copies it is to have; cut: the rank of the last document that gets a copy more (null: none does);
    ties: how many of rank cut do. weights: by source, None for all alike; total: copies in all, None for as many as docs.
    """
    spark = docs.sparkSession
    narrow = written(_keyed(docs, seed), "mixing")
    stats = narrow.groupBy("__aw_source").agg(F.count("*").alias("n"), F.sum("__aw_x").alias("sum_x"))
    if weights is None:
        wanted = stats.withColumn("weight", F.lit(1.0))
    else:
        named = [("0" if k is None else f"1{k}", float(v)) for k, v in weights.items() if v > 0]
        wanted = stats.join(spark.createDataFrame(named, "__aw_source string, weight double"), "__aw_source")
    wanted = written(wanted, "mixing-sources")
    all_ = wanted.agg(F.count("*"), F.sum("weight")).first()
    count, weight_sum = all_[0], all_[1] or 1.0
    total = narrow.count() if total is None else total
    figures = written(_sizes(wanted, count, weight_sum, total), "mixing-sizes")
    rows = _with(narrow, figures, count, ["share", "sum_x"])
    expected = _expected(F.col("__aw_x"), F.col("share"), F.col("sum_x"))
    rows = rows.withColumn("p", expected - F.floor(expected)).withColumn("q", _rank(F.col("__aw_u"), F.col("p")))
    # Rows without odds have no bucket; their certain copies count.
    rows = rows.withColumn("bucket", F.floor(F.log2("q") * BUCKETS)).withColumn("whole", F.floor(expected).cast("long"))
    buckets = written(rows.groupBy("__aw_source", "bucket").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")), "mixing-buckets")
    certain = buckets.groupBy("__aw_source").agg(F.sum("whole").alias("whole"))
    left = certain.join(figures, "__aw_source").select("__aw_source", (F.col("size") - F.col("whole")).alias("k"))
    upto = Window.partitionBy("__aw_source").orderBy("bucket")
    placed = buckets.filter("bucket is not null").select("__aw_source", "bucket", "n", F.sum("n").over(upto).alias("upto")).join(left, "__aw_source")
    edge = placed.filter("upto >= k and upto - n < k").select("__aw_source", F.col("bucket").alias("edge"), (F.col("k") - F.col("upto") + F.col("n")).alias("left"))
    near = rows.select("__aw_source", "bucket", "q").join(edge, "__aw_source").filter("bucket = edge")
    ranked = near.select("__aw_source", "q", "left", F.row_number().over(Window.partitionBy("__aw_source").orderBy("q")).alias("at"))
    cuts = ranked.groupBy("__aw_source", "q", "left").agg(F.count("*").alias("rows"), F.max("at").alias("last"), F.min("at").alias("first"))
    cuts = cuts.filter("first <= left and left <= last").select("__aw_source", F.col("q").alias("cut"), (F.col("left") - F.col("first") + 1).alias("ties"), F.col("rows").alias("at_cut"))
    done = written(figures.join(cuts, "__aw_source", "left"), "mixing-plan")
    return done, count


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED, copy: str = "copy") -> DataFrame:
    """docs, each row as many times as it is drawn, numbered from 1 in the column `copy`."""
    names, copy = docs.columns, free_name(docs.columns, copy)
    chosen, count = plan(docs, weights, total, seed)
    length = F.length(text_of(docs)).cast("long")
    source = F.when(docs["source"].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs["source"].cast("string")))
    rows = docs.select(F.struct(*[docs[f"`{n}`"] for n in names]).alias("__aw_row"), source.alias("__aw_source"), _measure(length).alias("__aw_x"), _uniform(seed, docs["doc_id"], length).alias("__aw_u"), length.alias("__aw_length"))
    rows = _with(rows, chosen, count, ["share", "sum_x", "cut", "ties"])
    expected = _expected(F.col("__aw_x"), F.col("share"), F.col("sum_x"))
    whole = F.floor(expected)
    rows = rows.withColumn("__aw_whole", whole.cast("long")).withColumn("__aw_q", _rank(F.col("__aw_u"), expected - whole))
    more = F.coalesce((F.col("__aw_q") <= F.col("cut")).cast("long"), F.lit(0))
    if chosen.filter("at_cut > ties").limit(1).count():
        # Rows that tie at a cut for fewer places: the places go in order of document.
        at = F.row_number().over(Window.partitionBy("__aw_source").orderBy("__aw_row.doc_id", "__aw_length", "__aw_row.text"))
        tied = rows.filter("__aw_q = cut").withColumn("__aw_more", (at <= F.col("ties")).cast("long"))
        every = rows.filter("__aw_q is null or cut is null or __aw_q <> cut").withColumn("__aw_more", more).unionByName(tied)
    else:
        every = rows.withColumn("__aw_more", more)
    every = every.withColumn("__aw_n", F.col("__aw_whole") + F.col("__aw_more")).filter("__aw_n > 0")
    out = every.select("__aw_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__aw_n"))).alias("__aw_copy"))
    return out.select(*[F.col("__aw_row").getField(n).alias(n) for n in names], F.col("__aw_copy").alias(copy))


#: DuckDB's restatement of mix() over documents with default parameters; only doc_id, source and copy.
SQL = f"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(length(text), 0) AS len FROM documents
), m AS (
  SELECT *, length(bin(len)) AS x,
         (CAST(concat('0x', substr(md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', CAST(len AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d
), s AS (
  SELECT source, sum(x) AS sum_x, 1.0::DOUBLE / (count(*) OVER ())::DOUBLE * (SELECT count(*) FROM d)::DOUBLE AS share FROM m GROUP BY source
), a AS (
  SELECT source, sum_x, share, CAST(floor(share) AS BIGINT)
         + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, source NULLS FIRST) <= (SELECT count(*) FROM d) - sum(CAST(floor(share) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS size
  FROM s
), e AS (
  SELECT m.*, s.size, s.share * m.x::DOUBLE / s.sum_x::DOUBLE AS lam
  FROM m JOIN a AS s ON m.source IS NOT DISTINCT FROM s.source
), r AS (
  SELECT *, CAST(floor(lam) AS BIGINT) AS whole, lam - floor(lam) AS p FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
         size - sum(whole) OVER (PARTITION BY source) AS k FROM r
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, len, text) AS place FROM q
), c AS (
  SELECT doc_id, source, whole + CASE WHEN p > 0 AND place <= k THEN 1 ELSE 0 END AS copies FROM n
)
SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy FROM c WHERE copies > 0
"""
