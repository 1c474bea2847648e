"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has 512 bits: the signs of the sum of its distinct plain words' hashes, each bit of a hash
counting as +1 or -1. Two documents are near copies when their fingerprints differ in at most MAX_DISTANCE bits; the
groups are what such pairs connect.

Three steps find the groups, and no pair within the distance is left out of what they connect:

1. Most links, cheaply. The first 504 bits form a ring of 56 segments of 9 bits. By the pigeonring principle a pair within the
distance has a segment from which on every chain of consecutive segments stays within its proportional budget: its
first k segments differ in k * MAX_DISTANCE / 56 bits at most. A pair is a candidate where the first segment of a chain
and one of the two after it are equal, and of large tables some bits more, so that buckets don't grow with the table. Two
exchanges lead to it: first only the chain's bits travel, by segment number, gap and the equal bits,
and rows without a partner within the budgets of the chains of up to nine segments drop out; the others fetch their
fingerprints and meet again for the full Hamming distance. Inside a bucket all pairs are
checked but only a spanning forest of the near ones is passed on. The groups of these links are labels.
2. The rest, exactly: `hamming.search` looks for every pair of fingerprints of different labels, at the full radius of the parts.
3. Its pairs are compared in full and join the labels.

Equal fingerprints are merged before the search, so exact copies never multiply pairs. Nothing is cut: no cap on a bucket, its
pairs or its size. The exact step does the fewer comparisons for each pair of fingerprints the more there are, but their number still
grows faster than the table.

Edge cases: a null text, or one without a word, has no fingerprint and no copy; rows that share a doc_id are one
document; a document whose doc_id is null is never a copy; of a group the document of the least doc_id stays, so equal
texts leave the least; an empty table gives an empty table; only doc_id and text are read, and drop_copies() returns
all columns as they came, whatever their names. one_of_each() decides by row, not by doc_id: texts without an id and
different texts under one id are near copies like any others, and of rows alike in both one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrweave.llm import hamming
from attrweave.llm.common import WordIds, components, cut, lean, mix64, pack, slices, text_of, unpack, written

WORDS = 8  # 64-bit words of a fingerprint
SEGMENT = 9
RING = 64 * WORDS // SEGMENT
#: Bits in which near copies may differ.
MAX_DISTANCE = 88
#: Segments of the chain whose budgets are checked before the whole fingerprint.
CHAIN = 9
#: How far behind a chain's first segment the other equal one is.
GAPS = (1, 2)
_PAIRS = 400_000  # pairs compared at a time
SMALL = 32  # rows of a bucket whose pairs are all listed
#: Fingerprints beyond which the key of a bucket has a bit more for each doubling; from which on the exact search has parts of
#: radius 3, not 2; and that one of its tasks holds.
BUCKETED, WIDE, HELD = 250_000, 500_000, 2_000_000


class _Bits:
    """The 512 bits of each word a worker has met, as bytes."""

    def __init__(self) -> None:
        self.words = WordIds(most=75_000)
        self.table = np.empty((0, 64 * WORDS), dtype=np.uint8)
        self.starts, self.words_done = 0, 0

    def of(self, words: list[str]) -> np.ndarray:
        """The number of each word, a row of self.table."""
        at = self.words.number(words)
        known = len(self.words.hashes)
        if self.starts != self.words.starts:
            self.starts, self.words_done = self.words.starts, 0
        if known > len(self.table):
            grown = np.empty((max(known, 2 * len(self.table)), 64 * WORDS), dtype=np.uint8)
            grown[: self.words_done] = self.table[: self.words_done]
            self.table = grown
        for start in range(self.words_done, known, 50_000):
            part = self.words.hashes[start : start + 50_000]
            self.table[start : start + len(part)] = np.unpackbits(_expand(part), axis=1)
        self.words_done = known
        return at


def _expand(hashes: np.ndarray) -> np.ndarray:
    """The 512 bits of each word hash, packed."""
    steps = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    return mix64(hashes[:, None] + steps).view(np.uint8)


def fingerprints(texts: list[str | None], bits: _Bits) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 64) bytes, and which texts have any word."""
    out, any_word = np.zeros((len(texts), 8 * WORDS), dtype=np.uint8), np.zeros(len(texts), dtype=bool)
    for k, text in enumerate(texts):
        found = list(set((text or "").split()))
        if not found:
            continue
        at = bits.of(found)
        _, once = np.unique(bits.words.hashes[at], return_index=True)
        at, sums = at[once], np.zeros(64 * WORDS, dtype=np.int64)
        for start in range(0, len(at), 255):  # a byte holds the sum of so many bits
            sums += np.add.reduce(bits.table[at[start : start + 255]], axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * sums > len(at))
        any_word[k] = True
    return out, any_word


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, fp (64 bytes) of the documents that have a word and an id."""
    source = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return source.mapInArrow(lean(_printed), "doc_id long, fp binary")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, the text, is replaced by its fingerprint, fp; those without a word drop out."""
    bits = _Bits()
    for batch in slices(batches, "text"):
        prints, found = fingerprints(batch.columns[-1].to_pylist(), bits)
        raw = pa.Array.from_buffers(pa.binary(8 * WORDS), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=[*batch.schema.names[:-1], "fp"]).filter(pa.array(found))


def segments(prints: np.ndarray) -> np.ndarray:
    """(fingerprints, RING) values of the ring's segments."""
    bits = np.unpackbits(prints, axis=1)[:, : RING * SEGMENT].reshape(len(prints), RING, SEGMENT)
    return bits @ (1 << np.arange(SEGMENT, dtype=np.int64))


def behind(gap: int) -> list[int]:
    """The segments of a chain but its first and the one `gap` behind it."""
    return [k for k in range(1, CHAIN) if k != gap]


def rest_of(ring: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The bits of the chain from each row's start on, but its two equal segments, as one number of 63 bits.

    place: the start, and RING more for each gap after the first.
    """
    steps = np.array([behind(g) for g in GAPS])[place // RING]
    own = np.take_along_axis(ring, (place[:, None] + steps) % RING, axis=1)
    return (own << (np.arange(CHAIN - 2) * SEGMENT)).sum(axis=1)


def _keyed(batches: Iterator[pa.RecordBatch], more: int = 0) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for each gap and chain start: their number and the bits of two segments, and the chain's rest.

    more: how many bits of the rest belong to the key as well.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            batch = whole.slice(at, 2_000)
            ring = segments(_matrix(batch.column(1)))
            rows = pa.array(np.repeat(np.arange(len(ring)), RING))
            for g, gap in enumerate(GAPS):
                keys = ((np.arange(RING) + g * RING) << (2 * SEGMENT)) | (ring << SEGMENT) | np.roll(ring, -gap, axis=1)
                rest = np.zeros_like(ring)
                for j, k in enumerate(behind(gap)):
                    rest |= np.roll(ring, -k, axis=1) << (j * SEGMENT)
                keys = keys << more | rest & ((1 << more) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rest.ravel()), batch.column(0).take(rows)], names=["chain", "rest", "doc_id"])


def within(apart: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    """Whether the differing bits of two chains' rests keep the budget of every chain of three segments or more."""
    live = np.arange(len(apart))
    for k in range(3, CHAIN + 1):
        live = live[np.bitwise_count(apart[live] & ((1 << ((k - 2) * SEGMENT)) - 1)) <= k * most / RING]
    ok = np.zeros(len(apart), dtype=bool)
    ok[live] = True
    return ok


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets of two rows or more of a partition that is sorted by chain."""
    held: pa.Table | None = None
    for batch in _then_none(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if held is not None:
            table = pa.concat_tables([held, table]) if table is not None else held
        if table is None or not table.num_rows:
            continue
        chains = table.column("chain").to_numpy()
        split = len(chains) if batch is None else int(np.searchsorted(chains, chains[-1]))
        held = table.slice(split)
        chains = chains[:split]
        same = np.concatenate([[False], chains[1:] == chains[:-1], [False]]) if split else np.zeros(1, dtype=bool)
        several = table.slice(0, split).filter(pa.array(same[1:] | same[:-1])) if split else None
        if several is not None and several.num_rows:
            yield several


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _pairs_of(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of buckets of up to SMALL rows, some at a time."""
    for size in np.unique(sizes[sizes <= SMALL]):
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, _PAIRS // len(i))
        for at in range(0, len(own), step):
            yield (own[at : at + step, None] + i).ravel(), (own[at : at + step, None] + j).ravel()


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (chain, rest, doc_id), those with a partner in their bucket within the chains' budgets."""
    for table in _buckets(batches):
        chains, rest = table.column("chain").to_numpy(), table.column("rest").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], chains[1:] != chains[:-1]]))
        sizes = np.diff(np.append(starts, len(chains)))
        partnered = np.zeros(len(chains), dtype=bool)
        for a, b in _pairs_of(sizes, starts):
            ok = within(rest[a] ^ rest[b])
            partnered[a[ok]] = partnered[b[ok]] = True
        for first, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own, found = rest[first : first + size], np.zeros(size, dtype=bool)
            for k in range(size):
                if not found[k]:
                    ok = within(own ^ own[k])
                    ok[k] = False
                    found |= ok
                    found[k] = ok.any()
            partnered[first : first + size] = found
        yield from table.select(["chain", "doc_id"]).filter(pa.array(partnered)).combine_chunks().to_batches()


def _matrix(column: pa.Array) -> np.ndarray:
    """The fingerprints of a binary column without nulls."""
    width = 8 * WORDS
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=len(column) * width, offset=_first(column)).reshape(-1, width)


def _first(column: pa.Array) -> int:
    return int(np.frombuffer(column.buffers()[1], dtype=np.int32, count=1, offset=4 * column.offset)[0]) if len(column) else 0


def near(wide: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = MAX_DISTANCE) -> np.ndarray:
    """Which pairs of rows keep the budgets of the chains from their start on, and then pass the full Hamming check.

    wide: the fingerprints as 64-bit words; rest: rest_of() each row. Pairs are of one bucket.
    """
    good = within(rest[a] ^ rest[b], most)
    live = np.flatnonzero(good)
    good[live] = np.bitwise_count(wide[a[live]] ^ wide[b[live]]).sum(axis=1, dtype=np.int32) <= most
    return good


def _linked(batches: Iterator[pa.RecordBatch], more: int = 0) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) within the buckets of sorted rows (chain, doc_id, fp). more: as in _keyed()."""
    for table in _buckets(batches):
        chains, ids = table.column("chain").to_numpy(), table.column("doc_id").to_numpy()
        prints = _matrix(table.column("fp").combine_chunks())
        wide, rest = np.ascontiguousarray(prints).view(np.uint64), np.empty(len(prints), dtype=np.int64)
        for at in range(0, len(prints), 20_000):
            rest[at : at + 20_000] = rest_of(segments(prints[at : at + 20_000]), chains[at : at + 20_000] >> (2 * SEGMENT + more))
        starts = np.flatnonzero(np.concatenate([[True], chains[1:] != chains[:-1]]))
        sizes = np.diff(np.append(starts, len(chains)))
        out_a, out_b = [], []
        for a, b in _pairs_of(sizes, starts):
            ok = near(wide, rest, a, b)
            out_a.append(ids[a[ok]])
            out_b.append(ids[b[ok]])
        for first, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            a, b = _forest(wide[first : first + size], rest[first : first + size])
            out_a.append(ids[first + a])
            out_b.append(ids[first + b])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def _forest(wide: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the near pairs among all the rows of a large bucket connect.

    A row that is reached is compared with the rows not reached yet, so every pair of different groups is compared.
    """
    left, a, b = np.arange(len(wide)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            row = queue.pop()
            hit = near(wide, rest, np.full(len(left), row), left)
            found = left[hit]
            a += [row] * len(found)
            b += found.tolist()
            queue += found.tolist()
            left = left[~hit]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def first_links(prints_of: DataFrame, more: int = 0) -> DataFrame:
    """Edges (a, b) of most of the near pairs of rows (doc_id, fp), and of nothing else."""
    keyed = prints_of.mapInArrow(lean(lambda batches: _keyed(batches, more)), "chain long, rest long, doc_id long")
    live = keyed.repartition("chain").sortWithinPartitions("chain").mapInArrow(lean(_partnered), "chain long, doc_id long")
    met = live.join(prints_of, "doc_id").select("chain", "doc_id", "fp")
    return met.repartition("chain").sortWithinPartitions("chain", "doc_id").mapInArrow(lean(lambda batches: _linked(batches, more)), "a long, b long")


def _tasks(parts: list[hamming.Part], top: int) -> list[tuple[int, int, int]]:
    """(part, tile, tile) of each task of the exact search."""
    return [(k, u, v) for k, part in enumerate(parts) for u, v in hamming.tiles(part, top)]


def _sends(parts: list[hamming.Part], top: int):
    """Rows task, body: what the tasks need of rows (doc_id, fp, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = _tasks(parts, top)
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                bits, done, numbers, bodies = np.unpackbits(_matrix(batch.column(1)), axis=1), -1, [], []
                for number, (k, u, v) in enumerate(tasks):
                    if k != done:
                        (key, one, two), done = hamming.keyed(bits, parts[k]), k
                        tile = key >> np.uint32(parts[k].width - top)
                    own = np.flatnonzero((tile == u) | (tile == v))
                    if len(own):
                        numbers.append(number)
                        bodies.append(pack(key[own], one[own], two[own], ids[own], labels[own] - ids[own]))
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary())], names=["task", "body"])

    return run


def _searched(parts: list[hamming.Part], top: int):
    """Rows a, b, one, two: documents that may be near, and their labels. A partition has one task at a time, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, held = _tasks(parts, top), {}
        for rows in batches:
            for number, body in zip(rows.column(0).to_pylist(), rows.column(1)):
                held.setdefault(number, []).append(body.as_py())
        for number in sorted(held):
            k, u, v = tasks[number]
            key, one, two, ids, over = (np.concatenate(x) for x in zip(*[unpack(body) for body in held.pop(number)]))
            label, out = ids + over, []
            del over
            for a, b in hamming.search(parts[k], key, one, two, label, u ^ v, top):
                if len(a):
                    out.append((a, b))
                if len(out) >= 1_000 or len(a) >= 50_000:
                    yield _pairs(ids, label, out)
                    out = []
            if out:
                yield _pairs(ids, label, out)

    return run


def _pairs(ids: np.ndarray, label: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found))
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], label[a], label[b])], names=["a", "b", "one", "two"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, first fingerprint, second), edges (a, b) between those within the distance."""
    for batch in batches:
        if batch.num_rows:
            apart = np.bitwise_count(_matrix(batch.column(2)) ^ _matrix(batch.column(3))).sum(axis=1, dtype=np.int32)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= MAX_DISTANCE))


def last_links(labelled: DataFrame, count: int, held: int = HELD, wide: int = WIDE) -> DataFrame:
    """Edges (a, b) between labels for every near pair of different labels, of `count` rows (doc_id, fp, label)."""
    parts = hamming.parts(64 * WORDS, MAX_DISTANCE, 2 if count < wide else 3)
    top = 0 if count <= held else math.ceil(math.log2(2 * count / held))
    sent = labelled.select("doc_id", "fp", "label").mapInArrow(lean(_sends(parts, top)), "task int, body binary")
    found = sent.repartitionById(len(_tasks(parts, top)), "task").mapInArrow(lean(_searched(parts, top)), "a long, b long, one long, two long")
    prints = labelled.select("doc_id", "fp")
    pairs = found.distinct().join(prints.select(F.col("doc_id").alias("a"), F.col("fp").alias("fp1")), "a").join(prints.select(F.col("doc_id").alias("b"), F.col("fp").alias("fp2")), "b")
    return pairs.select(F.col("one").alias("a"), F.col("two").alias("b"), "fp1", "fp2").mapInArrow(lean(_checked), "a long, b long").distinct()


def groups(prints: DataFrame) -> DataFrame:
    """Columns node, root: a row for each document of rows (doc_id, fp) with a near copy, and the least of its group."""
    owners = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")))
    prints_of = owners.select(F.col("owner").alias("doc_id"), "fp")
    count = owners.count()
    edges = first_links(prints_of, max(0, round(math.log2(max(1, count) / BUCKETED))))
    # A doc_id of several texts has several fingerprints: they count as one document.
    again = prints.join(owners, "fp").filter("doc_id <> owner").select(F.col("owner").alias("a"), F.col("doc_id").alias("b"))
    first = components(edges.union(again))
    labels = first.select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    labelled = cut(prints_of.join(labels, "doc_id", "left").select("doc_id", "fp", F.coalesce("label", "doc_id").alias("label")))
    last = components(last_links(labelled, count))
    known = first.union(last.select("node", F.col("node").alias("root"))).distinct()  # a label of `first` is its own root
    more = last.select(F.col("node").alias("label"), F.col("root").alias("least"))
    return known.join(more, known.root == more.label, "left").select("node", F.coalesce("least", "root").alias("root"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, kept_doc_id: a row for each document that goes, with the one of its group that stays."""
    roots = groups(written(with_fingerprints(docs, key, text), "simhash"))
    return roots.filter("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, without the near copies that go. The plan is the same at any size: both sides are sorted."""
    gone = near_copies(docs, key, text).select(F.col("doc_id").alias("__aw_gone")).hint("merge")
    return docs.join(gone, docs[key].cast("long") == gone["__aw_gone"], "left_anti")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with its columns, of each group of near copies; rows without a word all stay.

    Rows are told apart by id and text: the one of the least id stays, of an id's texts the one of the least hash, a row
    without an id only where its group has none with one; of rows alike in both the one whose columns have the least hash.
    """
    rows = _judged(docs, key, text).select(F.col("doc_id").alias("__aw_id"), F.col("tag").alias("__aw_tag"), "stays", "rows")
    gone = rows.filter("not stays").drop("stays", "rows").hint("merge")
    own = docs[key].cast("long").eqNullSafe(F.col("__aw_id")) & (F.xxhash64(text_of(docs, text)) == F.col("__aw_tag"))
    left = docs.join(gone, own, "left_anti")
    several = rows.filter("stays and rows > 1").drop("stays", "rows")
    if not several.limit(1).count():
        return left
    alike = docs.join(several, own, "left_semi").select(docs[key].cast("long").alias("id"), F.xxhash64(text_of(docs, text)).alias("tag"), F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"))
    by = Window.partitionBy("id", "tag").orderBy(F.xxhash64(F.to_json("row")))
    first = alike.withColumn("at", F.row_number().over(by)).filter("at = 1").select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
    return left.join(several.hint("merge"), own, "left_anti").unionByName(first)


def _judged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns doc_id, tag (the text's hash), rows (how many there are), stays: each id and text that has a near copy or comes again."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("tag"), text_of(docs, text).alias("text"))
    prints = written(source.mapInArrow(lean(_printed), "doc_id long, tag long, fp binary"), "simhash")
    # Fingerprints are numbered, and their numbers searched in place of ids.
    numbers = written(prints.select("fp").distinct().select(F.monotonically_increasing_id().alias("doc_id"), "fp"), "simhash-numbers")
    number = numbers.select(F.col("doc_id").alias("number"), "fp")
    named = prints.join(number, "fp").join(groups(numbers), F.col("number") == F.col("node"), "left")
    members = cut(named.groupBy(F.coalesce("root", "number").alias("group"), "doc_id", "tag").agg(F.count("*").alias("rows")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    least = members.groupBy(F.col("group").alias("of")).agg(F.min(own).alias("least"), F.sum("rows").alias("many")).filter("many > 1")
    return cut(members.join(least, F.col("group") == F.col("of")).select("doc_id", "tag", "rows", own.eqNullSafe(F.col("least")).alias("stays")))
