"""What the operators share: checkpoints, scratch tables, Arrow batches, text tokens and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Stripped from both ends of a word before it is compared.
PUNCTUATION = ".,;:!?#$%&*|()\"'[]{}«»¡¿…"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: Hadoop's default one where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def at_exit(spark: SparkSession, path: str) -> None:
    """Removes the path when the driver's JVM ends: results may be read from it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if where is None:
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attrweave-"))
        where = context.getCheckpointDir().get()
    elif context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
        at_exit(spark, context.getCheckpointDir().get())  # a folder of this application alone
    return qualified(spark, where)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the shared folder. A checkpoint would keep the size that its plan was estimated at,
    which a loop multiplies with every join until the numbers themselves take minutes."""
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, until the driver ends: lineage is cut and later reads prune columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(names: list[str], wanted: str) -> str:
    """The wanted name, with underscores behind it while a column has it."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted += "_"
    return wanted


def whole(df: DataFrame, column: str) -> Column:
    """The column as a long; a TypeError unless it holds whole numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{column} has to hold whole numbers, not {kind.simpleString()}")
    return df[f"`{column}`"].cast("long")


@functools.cache
def _trim() -> Callable[[int], object] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over batches, which gives the memory that it freed back to the system at its end: workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (trim := _trim()) is not None:
            trim(0)

    return wrapped


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string; a null counts as an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows whose texts have about limit bytes at most; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_ZSTD = pa.Codec("zstd", 3)


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed value."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    raw = b"".join([len(head).to_bytes(4, "little"), head, *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    """What pack() was given; the arrays can't be changed."""
    raw = _ZSTD.decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for x in raw[4:at].decode().split(";"):
        out.append(np.frombuffer(raw, dtype=x[:3], count=int(x[3:]), offset=at))
        at += out[-1].nbytes
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain(word: str) -> str:
    """The word in lower case without punctuation at its ends; a word of punctuation alone stays."""
    return word.strip(PUNCTUATION).lower() or word


class WordIds:
    """Numbers for words, one worker's memory of hashes; it starts anew beyond `most` words or `most_letters` in them."""

    def __init__(self, most: int = 400_000, most_letters: int = 16_000_000) -> None:
        from xxhash import xxh3_64_intdigest

        self.digest, self.most, self.most_letters, self.ids, self.letters = xxh3_64_intdigest, most, most_letters, {}, 0
        self.hashes = np.empty(0, dtype=np.uint64)
        self.starts = 0  # how often it has started anew

    def number(self, words: list[str]) -> np.ndarray:
        """The number of each word; self.hashes has the 64-bit hash of its plain form by number, until the next call."""
        ids = self.ids
        if len(ids) > self.most or self.letters > self.most_letters:
            ids.clear()
            self.letters = 0
            self.hashes = np.empty(0, dtype=np.uint64)
            self.starts += 1
        fresh = []
        for word in set(words).difference(ids):
            ids[word] = len(ids)
            self.letters += len(word)
            fresh.append(self.digest(plain(word)))
        if fresh:
            self.hashes = np.concatenate([self.hashes, np.array(fresh, dtype=np.uint64)])
        return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))

    def of(self, words: list[str]) -> np.ndarray:
        """The 64-bit hash of each plain word."""
        at = self.number(words)
        return self.hashes[at]


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root of every node of edges (a, b): root is the least node it is connected with.

    Least labels travel along the edges and each round then follows the label's own label, so chains take
    a logarithmic number of rounds. Each round is a written table.
    """
    # Both directions come from one evaluation of edges: two could differ where their order isn't fixed.
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.select(F.inline(ways)).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("least"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "least").alias("step"))
        jump = stepped.select(F.col("node").alias("via"), F.col("step").alias("far"))
        stepped = stepped.join(jump, stepped.step == jump.via, "left")
        after = cut(stepped.select("node", "old", F.least("step", F.coalesce("far", "step")).alias("root")))
        changed = after.filter("old <> root").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
