"""Cutting lineage, connected components and pairs by classes, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where the session names none, as in tests."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="attrweave-"))
    return context.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that goes when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where.getParent())
    system.deleteOnExit(where.getParent())
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder. A checkpoint would keep the size that its plan was estimated at, which a loop
    multiplies with every join until the numbers themselves take minutes; a table has the size of its files."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "n1", b: str = "n2") -> DataFrame:
    """Columns node, root: root is the least node that node is connected with.

    Least labels spread to neighbours and each round also follows the label's own label, so that long chains take few
    rounds.
    """
    # Both directions come from one evaluation of edges: two could differ where their order isn't fixed.
    ways = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    both = cut(edges.select(F.inline(ways)).filter("x is not null and y is not null").distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("root").alias("old"), F.least("root", "m").alias("new"))
        far = step.select(F.col("node").alias("via"), F.col("new").alias("far"))
        after = cut(step.join(far, step.new == far.via, "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("root")))
        labels = after.select("node", "root")
        if not after.filter("old <> root").limit(1).count():
            return labels


def width(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions by a number of one's own, which Spark doesn't lower by their bytes: for rows that are few but much work, or large
    once they are in a table of memory. df: no fewer than one for each 16 MB of the files that it reads."""
    least = 0
    if df is not None:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
        least = sum(x for x in sizes if x < 1 << 60) >> 24  # more is said of tables of unknown size
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(least, 10_000))


def beside(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """large joined with small, of which a key may meet most of large: each key is spread over as many copies as there are tasks,
    by the columns `by` of large."""
    n = width(large.sparkSession)
    copies = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return large.withColumn("__s", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).join(copies, [*on, "__s"], how).drop("__s")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place in the order, from 0, counted by ranges of the order and not in one task."""
    placed = cut(df.repartitionByRange(width(df.sparkSession), *order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return placed.withColumn(name, place).join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")


def alike(items: DataFrame, key: list[str], item: str) -> DataFrame:
    """items with a column r: of the rows that agree in `key` (their class) the least item, which stands for all of them."""
    return items.withColumn("r", F.min(F.struct(F.col(item))).over(Window.partitionBy(*key))[item])


def product(pairs: DataFrame, members: DataFrame, key: list[str], item: str, most: int = 1024) -> DataFrame:
    """pairs of classes as pairs of their members: columns `{item}1`, `{item}2` in place of r1, r2.

    members: r, item and the columns of key, which are in pairs too, by their own name or followed by 1 and 2. A class is cut into
    lists of `most` members; each pair of lists is one row until its task writes its members out, so they are never shuffled.
    """
    place = F.row_number().over(Window.partitionBy(*key, "r").orderBy(item))
    lists = members.withColumn("k", F.floor((place - 1) / most)).groupBy(*key, "r", "k").agg(F.collect_list(F.struct(F.col(item))).alias("m"))
    met = pairs
    for side in ("1", "2"):
        own = {c: c if c in pairs.columns else c + side for c in key} | {c: c + side for c in ("r", "k", "m")}
        mine = lists.withColumnsRenamed(own)
        same = [met[c].eqNullSafe(mine[c]) for c in [*[own[c] for c in key], f"r{side}"]]
        met = met.join(mine, reduce(and_, same)).select(*[met[c] for c in met.columns], f"k{side}", f"m{side}")
    met = met.repartition(width(pairs.sparkSession), "r1", "r2", "k1", "k2")
    rest = [c for c in pairs.columns if c not in ("r1", "r2")]
    one = met.select(*rest, "m2", F.explode("m1").alias("x"))
    two = one.select(*rest, F.col(f"x.{item}").alias(f"{item}1"), F.explode("m2").alias("y"))
    return two.select(*rest, f"{item}1", F.col(f"y.{item}").alias(f"{item}2"))


def paired(rows: DataFrame, group: str, item: str, block: str, score: str, least: float, by: list[str] = ()) -> DataFrame:
    """Columns by, group1, item1, group2, item2, score: pairs of items of different groups, the lesser first, that share blocks, of
    which the first's scores sum to `least`.

    Only blocks of two groups can pair anything. Items of one group with equal blocks are one class: blocks are met by classes, and
    a pair of classes is written out as the pairs of its items.
    """
    key, cell = [*by, group], [*by, block]
    two = rows.groupBy(*cell).agg(F.min(group).alias("a"), F.max(group).alias("z")).filter("a < z").select(*cell)
    own = rows.join(two, cell, "left_semi").groupBy(*key, item).agg(F.sort_array(F.collect_list(F.struct(F.col(block), F.col(score)))).alias("p"))
    held = cut(alike(own, [*key, "p"], item))
    first = held.filter(F.col("r").eqNullSafe(F.col(item))).select(*key, "r", F.inline("p"))
    left = first.select(*cell, score, F.col(group).alias(f"{group}1"), F.col("r").alias("r1"))
    right = first.select(*cell, F.col(group).alias(f"{group}2"), F.col("r").alias("r2"))
    n = width(rows.sparkSession)
    met = left.repartition(n, *cell).join(right.repartition(n, *cell), cell).filter(F.col(f"{group}1") < F.col(f"{group}2"))
    summed = met.groupBy(*by, f"{group}1", "r1", f"{group}2", "r2").agg(F.sum(score).alias(score)).filter(F.col(score) >= least)
    return product(summed, held.select(*key, "r", item), key, item).select(*by, f"{group}1", f"{item}1", f"{group}2", f"{item}2", score)
