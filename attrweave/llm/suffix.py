"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is what follows a word; only its first `depth` plain words count. It is sorted by digits, the most significant
first: the first digit is its first GRAM words, and each later one twice as many of the words that follow, up to `depth`
(8, 16 and 26 words). A pass orders the suffixes inside each group of the pass before by their next digit; groups of one
drop out at once, and nothing beyond `depth` is looked at. The groups of the last pass are the repeated windows.

1. Documents are read once: each batch of them becomes one row with numbers for words and the words' 64-bit hashes, written as a
   table. Later passes read that, never the texts.
2. A pass sends, from each batch, the group of each suffix after its digit, once for each batch: a key, sorted, as
   differences, to a bucket of keys. The bucket answers one bit for each key, whether another suffix has it too. With the bits
   the batch keeps the suffixes that aren't alone, and the words that they span.
3. The last pass also sends the first document of each group and is answered which document is the first of all.

A popular passage reaches a bucket once for each batch, never once for each occurrence, so no task grows with it. Values of
digits are hashes, so the order among groups is arbitrary but fixed; the groups of the last pass are told apart by 96 bits:
with 10 ** 13 suffixes, two different windows share a group with a chance of less than one in a hundred.

Each repeated window but its first occurrence, in order of doc_id and position, is a copy. Neighbouring windows join to
spans of words.

Where copies overlap their own first occurrence, as in periodic text, each word that goes has an equal one before it that
stays: one period is left.

Edge cases: a null or empty text, or one of less than `depth` words, has no window; documents are told apart by doc_id and
text, so fully repeated rows count as one document, and different texts under one doc_id as two; a null doc_id counts
as an id below all others; a passage that repeats inside one document is found as well; a text of any length is one piece
of a batch, as long as memory allows; an empty table gives an empty table; only doc_id and text are read, and
remove_repeats() returns all columns as they came.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import WordIds, lean, mix64, pack, ranges, slices, text_of, unpack, written

#: Words of a window.
DEPTH = 50
#: Words of the first digit.
GRAM = 8
#: Bytes of text of a batch, and keys of a bucket, about: what a task holds at a time.
BATCH_BYTES, BUCKET_KEYS = 3_000_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
SPAN = "doc_id long, tag long, start int, stop int, kept boolean, first_doc_id long"


def window_hashes(words: np.ndarray, width: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """A hash of each run of width words, modulo 2 ** 64 and mixed."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, odd, dtype=np.uint64)]), dtype=np.uint64)
    # Widths of powers of two double up: H(2k)[i] = H(k)[i] * odd ** k + H(k)[i + k].
    whole, at, have, done = None, words.astype(np.uint64), 1, 0
    left = width
    while left:
        if left & 1:
            part = at[done : done + count]
            whole = part if whole is None else whole * power[have] + part
            done += have
        left >>= 1
        if left:
            at = at[: len(at) - have] * power[have] + at[have:]
            have *= 2
    return mix64(whole + np.uint64(width))


def digit_ends(depth: int, gram: int) -> list[int]:
    """Where each digit ends, in words: each is twice as long as the one before, the last ends at depth."""
    ends, width = [], gram
    while not ends or ends[-1] < depth:
        ends.append(min(depth, (ends[-1] if ends else 0) + width))
        width *= 2
    return ends


def groups(words: np.ndarray, places: np.ndarray, ends: list[int], odd: np.uint64 = _ODD) -> np.ndarray:
    """The group of the suffix at each place after the digits that end at `ends`."""
    group, start = np.zeros(len(places), dtype=np.uint64), 0
    for end in ends:
        digit = window_hashes(words, end - start, odd)[places + start]
        group = digit if start == 0 else mix64(group * odd + digit)
        start = end
    return group


@dataclass
class Batch:
    """Stretches of words of some documents, one after the other, and the places of suffixes that aren't alone so far.

    Documents are in order of doc_id and tag, stretches in order of document and start.
    """

    doc_id: np.ndarray
    tag: np.ndarray
    doc: np.ndarray  # of each stretch
    start: np.ndarray
    length: np.ndarray
    codes: np.ndarray  # of each word, the place of its hash in names
    names: np.ndarray
    places: np.ndarray

    def body(self) -> bytes:
        live = np.zeros(len(self.codes), dtype=bool)
        live[self.places] = True
        codes = self.codes.astype(np.uint16 if len(self.names) <= 1 << 16 else np.uint32)
        return pack(self.doc_id, self.tag, self.doc.astype(np.int32), self.start.astype(np.int32), self.length.astype(np.int32), codes, self.names, np.packbits(live))

    @staticmethod
    def of(body: bytes) -> Batch:
        doc_id, tag, doc, start, length, codes, names, live = unpack(body)
        return Batch(doc_id, tag, doc.astype(np.int64), start.astype(np.int64), length.astype(np.int64), codes, names, np.flatnonzero(np.unpackbits(live, count=len(codes))))

    @property
    def words(self) -> np.ndarray:
        return self.names[self.codes]

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    def stretch(self) -> np.ndarray:
        """The stretch of each place."""
        return np.searchsorted(np.cumsum(self.length), self.places, side="right")

    def kept(self, live: np.ndarray, depth: int) -> Batch:
        """The batch with the places that are live, and the words that these span."""
        places, stretch = self.places[live], self.stretch()[live]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(places) > depth)]))
        first, last = places[head], places[np.append(head[1:], len(places)) - 1]
        length, own = last - first + depth, stretch[head]
        offsets = np.cumsum(length) - length
        used, codes = np.unique(self.codes[ranges(first, length)], return_inverse=True)
        return Batch(self.doc_id, self.tag, self.doc[own], self.start[own] + first - self.offsets[own], length, codes, self.names[used], places + np.repeat(offsets - first, np.diff(np.append(head, len(places)))))


def _read(depth: int, batch_bytes: int):
    """Rows batch, places, body of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordIds(150_000)
        for batch in slices(batches, "text", batch_bytes):
            ids, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            order = np.lexsort((tags, ids))
            same = np.concatenate([[False], (np.diff(ids[order]) == 0) & (np.diff(tags[order]) == 0)])
            found, docs, hashes = [], [], []
            for k in order[~same]:
                words = texts[k].split()
                if len(words) >= depth:
                    # Numbers hold until the next call that starts anew, so each document's are made hashes at once.
                    hashes.append(numbers.of(words))
                    found.append(len(words))
                    docs.append(k)
            if not docs:
                continue
            length = np.array(found)
            names, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            places = ranges(np.cumsum(length) - length, length - depth + 1)
            own = Batch(ids[docs], tags[docs], np.arange(len(docs)), np.zeros(len(docs), dtype=np.int64), length, codes, names, places)
            yield pa.RecordBatch.from_arrays([pa.array([len(places)], pa.int64()), pa.array([own.body()], pa.binary())], names=["places", "body"])

    return run


def _squeezed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as the first of them and the bytes of their differences, by significance."""
    steps = np.diff(keys)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return keys[:1], np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _spread(first: np.ndarray, planes: np.ndarray, count: int) -> np.ndarray:
    steps = np.zeros((count, 8), dtype=np.uint8)
    if count > 1:
        steps[1:, : len(planes) // (count - 1)] = planes.reshape(-1, count - 1).T
    steps = steps.view(np.uint64).reshape(-1)
    steps[:1] = first
    return np.cumsum(steps, dtype=np.uint64)


@functools.cache
def _edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // buckets for k in range(1, buckets)], dtype=np.uint64)


def _bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted keys of so many bits, and their end."""
    return np.concatenate([[0], np.searchsorted(keys, _edges(buckets, bits)), [len(keys)]])


def _sends(ends: list[int], buckets: int, bits: int):
    """Rows bucket, batch, body: the groups of a batch's suffixes, and which of them it has more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, body in zip(rows.column(0).to_pylist(), rows.column(1)):
                batch = Batch.of(body.as_py())
                keys, times = np.unique(groups(batch.words, batch.places, ends) >> np.uint64(64 - bits), return_counts=True)
                cuts, out = _bounds(keys, buckets, bits), []
                live = np.flatnonzero(np.diff(cuts))
                for k in live:
                    a, b = cuts[k], cuts[k + 1]
                    out.append(pack(np.array([b - a]), *_squeezed(keys[a:b]), np.packbits(times[a:b] > 1)))
                yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(np.full(len(live), number)), pa.array(out, pa.binary())], names=["bucket", "batch", "body"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, which keys of each batch are of more suffixes than one."""
    bucket, number, keys, many = 0, [], [], []
    for rows in batches:
        for k, n, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2)):
            (count,), first, planes, bits = unpack(body.as_py())
            bucket = k
            number.append(n)
            keys.append(_spread(first, planes, count))
            many.append(np.unpackbits(bits, count=count).astype(bool))
    if not number:
        return
    size = [len(x) for x in keys]
    keys, many = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    live = np.empty(len(keys), dtype=bool)
    live[order] = many[order] | np.concatenate([[False], same]) | np.concatenate([same, [False]])
    cuts = np.cumsum([0, *size])
    for at in range(0, len(number), 1000):
        upto = range(at, min(at + 1000, len(number)))
        out = [pack(np.array([size[k]]), np.packbits(live[cuts[k] : cuts[k + 1]])) for k in upto]
        yield pa.RecordBatch.from_arrays([pa.array([number[k] for k in upto], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["batch", "bucket", "body"])


def _thinned(ends: list[int], bits: int, depth: int):
    """The batches with what their answers leave; rows of batch, body, answers in order of bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for body, answers in zip(rows.column(1), rows.column(2)):
                batch = Batch.of(body.as_py())
                parts = [unpack(x["body"]) for x in answers.as_py()]
                live = np.concatenate([np.unpackbits(b, count=n[0]) for n, b in parts]).astype(bool)
                _, number = np.unique(groups(batch.words, batch.places, ends) >> np.uint64(64 - bits), return_inverse=True)
                live = live[number]
                if live.any():
                    batch = batch.kept(live, depth)
                    yield pa.RecordBatch.from_arrays([pa.array([len(batch.places)], pa.int64()), pa.array([batch.body()], pa.binary())], names=["places", "body"])

    return run


def _windows(batch: Batch, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the places by window, heads of equal ones in it, windows' 64 bits, 32 bits more), the earliest place first."""
    words = batch.words
    high, low = groups(words, batch.places, ends), (groups(words, batch.places, ends, _OTHER) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    heads = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return order, heads, high[heads], low[heads]


def _owners(ends: list[int], buckets: int):
    """Rows bucket, batch, body: a batch's windows, the first document of each, and whether it has the window again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, body in zip(rows.column(0).to_pylist(), rows.column(1)):
                batch = Batch.of(body.as_py())
                order, heads, high, low = _windows(batch, ends)
                doc, more = batch.doc[batch.stretch()][order[heads]], np.diff(np.append(heads, len(order))) > 1
                cuts, out = _bounds(high, buckets, 64), []
                live = np.flatnonzero(np.diff(cuts))
                for k in live:
                    a, b = cuts[k], cuts[k + 1]
                    docs, at = np.unique(doc[a:b], return_inverse=True)
                    out.append(pack(*_squeezed(high[a:b]), low[a:b], at.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32), batch.doc_id[docs], batch.tag[docs], np.packbits(more[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(np.full(len(live), number)), pa.array(out, pa.binary())], names=["bucket", "batch", "body"])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, for each window of a batch: 0 it is alone, 1 the batch has its first document, 2 another has; and that one."""
    bucket, number, parts = 0, [], []
    for rows in batches:
        for k, n, body in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2)):
            first, planes, low, at, ids, tags, more = unpack(body.as_py())
            bucket = k
            number.append(n)
            parts.append((_spread(first, planes, len(low)), low, ids[at], tags[at], np.unpackbits(more, count=len(low)).astype(bool)))
    if not number:
        return
    size = [len(x[1]) for x in parts]
    high, low, ids, tags, more = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((tags, ids, low, high))
    head = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
    group = np.cumsum(head) - 1
    lead = order[head][group]  # the row with the first document, for each row in order
    other = (ids[order] != ids[lead]) | (tags[order] != tags[lead])
    repeated = np.zeros(group[-1] + 1, dtype=bool)
    repeated[group[other | more[order]]] = True
    status, first = np.empty(len(high), dtype=np.uint8), np.empty(len(high), dtype=np.int64)
    status[order] = np.where(repeated[group], 1 + other, 0)
    first[order] = ids[lead]
    cuts = np.cumsum([0, *size])
    for at in range(0, len(number), 1000):
        out, upto = [], range(at, min(at + 1000, len(number)))
        for k in upto:
            own = status[cuts[k] : cuts[k + 1]]
            docs, place = np.unique(first[cuts[k] : cuts[k + 1]][own == 2], return_inverse=True)
            out.append(pack(own, docs, place.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array([number[k] for k in upto], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["batch", "bucket", "body"])


def _spans(ends: list[int]):
    """Runs of repeated windows, from rows of batch, body, answers in order of bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for body, answers in zip(rows.column(1), rows.column(2)):
                batch = Batch.of(body.as_py())
                order, heads, _, _ = _windows(batch, ends)
                parts = [unpack(x["body"]) for x in answers.as_py()]
                status = np.concatenate([x[0] for x in parts])
                first = np.zeros(len(status), dtype=np.int64)
                first[status == 2] = np.concatenate([docs[place] for _, docs, place in parts])
                stretch = batch.stretch()
                doc = batch.doc[stretch]
                first = np.where(status == 1, batch.doc_id[doc[order[heads]]], first)
                window = np.empty(len(order), dtype=np.int64)
                window[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
                kept = np.zeros(len(order), dtype=bool)
                kept[order[heads]] = status == 1
                live = np.flatnonzero(status[window] > 0)
                if not len(live):
                    continue
                at = batch.start[stretch] + batch.places - batch.offsets[stretch]
                facts = np.column_stack([doc, at, kept, first[window]])[live].astype(np.int64)
                # Neighbours of one document with the same verdict and source join.
                same = (facts[1:, [0, 2, 3]] == facts[:-1, [0, 2, 3]]).all(axis=1) & (facts[1:, 1] == facts[:-1, 1] + 1)
                a = np.flatnonzero(np.concatenate([[True], ~same]))
                z = np.append(a[1:], len(facts)) - 1
                own = facts[a, 0]
                yield pa.RecordBatch.from_arrays([pa.array(batch.doc_id[own]), pa.array(batch.tag[own]), pa.array(facts[a, 1].astype(np.int32)), pa.array(facts[z, 1].astype(np.int32)), pa.array(facts[a, 2] == 1), pa.array(facts[a, 3])], names=["doc_id", "tag", "start", "stop", "kept", "first_doc_id"])

    return run


def _answered(batches: DataFrame, sent: DataFrame, buckets: int, answer) -> DataFrame:
    """Columns batch, body, answers (in order of bucket) of the batches."""
    answers = sent.repartitionById(buckets, "bucket").mapInArrow(lean(answer), "batch long, bucket int, body binary")
    answers = answers.groupBy(F.col("batch").alias("of")).agg(F.sort_array(F.collect_list(F.struct("bucket", "body"))).alias("answers"))
    return batches.join(answers, batches["batch"] == answers["of"]).select("batch", "body", "answers")


def _numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The batches with numbers, and the places in all. Written, the numbers are the same to every reader."""
    batches = written(rows.withColumn("batch", F.monotonically_increasing_id()), name)
    return batches, batches.agg(F.sum("places")).first()[0] or 0


def repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Columns doc_id, tag, start, stop, kept, first_doc_id: runs of repeated windows by their first and last start.

    kept: these are the first occurrences; else first_doc_id has the document of the first one.
    tag tells the texts of one doc_id apart.
    """
    text = text_of(docs)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches, places = _numbered(source.mapInArrow(lean(_read(depth, batch_bytes)), "places long, body binary"), "suffix-words")
    ends = digit_ends(depth, min(gram, depth))
    for k in range(1, len(ends)):
        # Keys have as many bits as leave one in a thousand suffixes a chance partner; the next pass tells these apart.
        bits, buckets = min(64, max(24, places.bit_length() + 10)), max(least, -(-places // bucket_keys))
        own = batches.select("batch", "body")
        sent = own.mapInArrow(lean(_sends(ends[:k], buckets, bits)), "bucket int, batch long, body binary")
        thinned = _answered(own, sent, buckets, _answers).mapInArrow(lean(_thinned(ends[:k], bits, depth)), "places long, body binary")
        batches, places = _numbered(thinned, "suffix-words")
    buckets = max(least, -(-places // max(1, bucket_keys // 2)))
    own = batches.select("batch", "body")
    sent = own.mapInArrow(lean(_owners(ends, buckets)), "bucket int, batch long, body binary")
    return _answered(own, sent, buckets, _firsts).mapInArrow(lean(_spans(ends)), SPAN)


def _merged(spans: DataFrame, depth: int) -> DataFrame:
    """Columns doc_id, tag, pieces: an array of (start, stop, kept, first_doc_id) in words, stop exclusive, joined."""
    return spans.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("stop") + depth).alias("stop"), "kept", "first_doc_id"))).alias("pieces"))


def passages(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """Columns doc_id, start_word, stop_word, kept, first_doc_id of each repeated passage of depth words or more.

    Passages of one document that overlap and have the same verdict and source are joined.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_: dict[tuple[bool, int], list] = {}
                for p in pieces:
                    own = open_.get(key := (p["kept"], p["first_doc_id"]))
                    if own and p["start"] <= own[2]:
                        own[2] = max(own[2], p["stop"])
                    else:
                        open_[key] = own = [doc, p["start"], p["stop"], *key]
                        rows.append(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], names=["doc_id", "start_word", "stop_word", "kept", "first_doc_id"])

    merged = _merged(repeats(docs, depth, gram), depth).select("doc_id", "pieces")
    found = merged.mapInArrow(lean(join), "doc_id long, start_word int, stop_word int, kept boolean, first_doc_id long")
    none = F.lit(-(2**63))
    return found.withColumns({c: F.when(F.col(c) != none, F.col(c)) for c in ("doc_id", "first_doc_id")})


def without(text: str, pieces: list[tuple[int, int]]) -> str:
    """The text without the words of the pieces (sorted, stop exclusive) and the white space after them."""
    ends = [m.span() for m in re.finditer(r"\S+", text)]
    out, at = [], 0
    for start, stop in pieces:
        a, b = ends[start][0], ends[stop][0] if stop < len(ends) else len(text)
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out).rstrip() if pieces else text


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """docs with their columns; of each repeated passage only the first occurrence stays.

    A document of which nothing stays is dropped; n_chars, where docs have it, follows the text.
    """
    names = docs.columns
    copies = repeats(docs, depth, gram).filter("not kept")
    pieces = copies.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("stop") + depth).alias("stop")))).alias("__aw_pieces")).withColumnsRenamed({"doc_id": "__aw_id", "tag": "__aw_tag"})
    text = text_of(docs)
    joined = docs.join(pieces, (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))) == pieces["__aw_id"]) & (F.xxhash64(text) == pieces["__aw_tag"]), "left").select(*[docs[f"`{n}`"] for n in names], "__aw_pieces")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.compute.is_valid(batch.column(len(names)))
            columns, keep = list(batch.columns[:-1]), pa.array(np.ones(batch.num_rows, dtype=bool))
            if pa.compute.any(hit).as_py():
                texts, gone = batch.column(at).to_pylist(), []
                for k in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
                    texts[k] = without(texts[k], [(p["start"], p["stop"]) for p in batch.column(len(names))[int(k)].as_py()])
                    if not texts[k].strip():
                        gone.append(int(k))
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    c = names.index("n_chars")
                    columns[c] = pa.compute.if_else(hit, pa.compute.utf8_length(columns[at]).cast(columns[c].type), columns[c])
                keep = pa.array(~np.isin(np.arange(batch.num_rows), gone))
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return joined.mapInArrow(lean(run), docs.schema)
