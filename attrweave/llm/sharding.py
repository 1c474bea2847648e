"""Sharding by histogram sort: ordered shards of about equal bytes after a single exchange.

The splitters between shards are sought before anything moves. In each round every open splitter has a few candidate keys
spread over the interval it is known to lie in; each partition counts its bytes below all candidates, the sums of all
partitions are exact, and the intervals shrink to the candidates on either side of the target. A splitter is closed as
soon as a candidate lies within `tolerance` of its target, or when its interval holds no further key. The rounds read a
narrow table (key, bytes) that is written once; then rows are exchanged once, straight to the partition of their shard,
and sorted there.

What is sent to tasks and gathered is a few numbers per shard. Unless shard_bytes is given, a shard is what leaves TASKS for
each core, within LEAST_BYTES and MOST_BYTES.

Edge cases: a null key sorts before all others; a null text has no bytes; rows of equal keys stay together, so a shard
can be larger than asked when they outweigh it; a text above shard_bytes fills a shard of its own; an empty table gives
an empty table; keys are whole numbers, and a column of another type is refused with a TypeError; the columns come back as
they were, with `shard` added, named with an underscore behind it while docs have a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import free_name, text_of, whole, written

#: Shards for each core, and bytes of a shard at least and at most.
TASKS, LEAST_BYTES, MOST_BYTES = 4, 256 << 10, 1 << 30
#: Part of a shard by which a splitter may miss its target.
TOLERANCE = 0.01
#: Candidate keys of an open splitter in a round.
PROBES = 16
_LEAST, _MOST = -(2**63), 2**63 - 1


def _key(docs: DataFrame, key: str) -> Column:
    return F.coalesce(whole(docs, key), F.lit(_LEAST))


def _below(sizes: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the keys below each of the sorted probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(sums, at, batch.column(1).to_numpy())
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["at", "bytes"])

    found = sizes.mapInArrow(count, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect()
    sums = np.zeros(len(probes) + 1, dtype=np.int64)
    for at, size in found:
        sums[at] = size
    return np.cumsum(sums)[:-1]


def candidates(low: int, high: int, count: int) -> list[int]:
    """At most count keys in low + 1 .. high, evenly spread."""
    width = high - low
    if width <= count:
        return list(range(low + 1, high + 1))
    return sorted({low + width * k // (count + 1) for k in range(1, count + 1)} - {low})


def splitters(sizes: DataFrame, shard_bytes: int | None = None, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """Keys, ascending, at which a new shard begins. sizes: columns key (long), bytes (long)."""
    low_key, high_key, total = sizes.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if not total:
        return []
    if shard_bytes is None:
        shard_bytes = min(max(-(-total // (TASKS * sizes.sparkSession.sparkContext.defaultParallelism)), LEAST_BYTES), MOST_BYTES)
    shards = -(-total // shard_bytes)
    targets = [total * k // shards for k in range(1, shards)]
    slack = int(tolerance * total / shards)
    # Bytes below `low` are under the target, those below `high` reach it.
    intervals = {k: [low_key, high_key + 1 if high_key < _MOST else _MOST, 0, total] for k in range(len(targets))}
    done: dict[int, int] = {}
    while intervals:
        asked = {k: candidates(v[0], v[1] - 1, probes) for k, v in intervals.items()}
        keys = np.array(sorted({p for own in asked.values() for p in own}), dtype=np.int64)
        below = dict(zip(keys.tolist(), _below(sizes, keys).tolist())) if len(keys) else {}
        for k, own in asked.items():
            interval, target = intervals[k], targets[k]
            for p in own:
                if below[p] < target and p > interval[0]:
                    interval[0], interval[2] = p, below[p]
                if below[p] >= target and p < interval[1]:
                    interval[1], interval[3] = p, below[p]
            nearer = 0 if target - interval[2] <= interval[3] - target else 1
            if abs(interval[2 + nearer] - target) <= slack or interval[1] - interval[0] <= 1 or not own:
                done[k] = interval[nearer]
                del intervals[k]
    return sorted(set(done.values()) - {low_key})


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int | None = None, tolerance: float = TOLERANCE, probes: int = PROBES, name: str = "shard") -> DataFrame:
    """docs with their columns and the number of their shard; a partition per shard, sorted by key."""
    sizes = written(docs.select(_key(docs, key).alias("key"), F.octet_length(text_of(docs, text)).cast("long").alias("bytes")), "sharding")
    cuts = splitters(sizes, shard_bytes, tolerance, probes)
    kept, borders = docs.columns, np.array(cuts, dtype=np.int64)

    def place(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in keys:
            yield pa.array(np.searchsorted(borders, own.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    place.__annotations__ = {"keys": Iterator[pa.Array], "return": Iterator[pa.Array]}
    number = F.arrow_udf(place, "int")(_key(docs, key)) if cuts else F.lit(0)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("__aw_row"), _key(docs, key).alias("__aw_key"), number.alias("__aw_shard"))
    placed = rows.repartitionById(len(cuts) + 1, "__aw_shard").sortWithinPartitions("__aw_key")
    return placed.select(*[F.col("__aw_row").getField(c).alias(c) for c in kept], F.col("__aw_shard").alias(free_name(kept, name)))
