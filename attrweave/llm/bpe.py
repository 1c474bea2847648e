"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens; the adjacent parts of a pre-token whose joint bytes have the least rank in the vocabulary
are merged, the leftmost first, until none is left. The parts are a doubly linked list of positions. A queue has a bucket
per rank with the positions of the pairs of that rank, and a bitmap of two levels over the buckets that aren't
empty: find-first-set, first on the upper and then on the lower level, gives the least rank. A merge leaves stale entries of the pairs it
destroyed behind; they are recognised by their rank when they come up, and skipped. A pre-token of n bytes takes
O(n log n) at most, however long it is. Encoded pre-tokens are remembered by a worker, by their text, up to a number of letters.

The vocabulary is a file whose path is a parameter; it is sent to executors that don't have it.

Decoding concatenates the bytes of the ids.

Edge cases: null and empty texts give no ids (an empty array); decoding gives an empty text; every text round-trips, since
each byte is a token; bytes that aren't UTF-8 (from ids cut elsewhere) decode to replacement characters; strings of
special tokens are ordinary text; a null id is skipped; an empty table gives an empty table; only the named columns are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrweave.llm.common import lean, ranges, slices, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens: contractions, letters, numbers and signs, each with a space before it, and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs between which no pre-token reaches: PATTERN cuts each of them as it would within the text.
_RUNS = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
_PRE = regex.compile(PATTERN)
#: Bits of a bitmap's word number and place: two levels hold ranks below 2 ** 18.
BITS = 9
MASK = (1 << BITS) - 1
#: Runs, and letters in them, that a worker remembers before it starts anew; what one batch adds comes on top.
MEMORY, LETTERS = 800_000, 32_000_000


class Codec:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pieces = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([k])] for k in range(256)])
        self.pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that aren't empty, one after the other, and how many each has.

        One queue serves all of them: no pair reaches over their edges, and their orders don't affect each other.
        """
        whole, get = b"".join(pieces), self.ranks.get
        n, ends = len(whole), np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        codes = np.frombuffer(whole, dtype=np.uint8)
        edge = np.zeros(n + 1, dtype=np.uint8)
        edge[0] = 1
        edge[ends] = 1
        pair = self.pairs[codes[:-1], codes[1:]]
        pair[edge[1:-1] == 1] = -1
        # A part is named by its first byte; stop[i] is where it ends, back[i] where the part before it begins.
        stop, back = list(range(1, n + 1)), np.arange(-1, n - 1)
        back[edge[:-1] == 1] = -1
        back, edges, alive, ids = back.tolist(), edge.tobytes(), bytearray(b"\1" * n), self.single[codes].tolist()
        rank_at = [*pair.tolist(), -1]
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        heads = np.flatnonzero(np.diff(pair[order], prepend=-1))
        buckets = {r: x.tolist() for r, x in zip(pair[order[heads]].tolist(), np.split(order, heads[1:]))} if len(order) else {}
        # The bits of the buckets that aren't empty, by word, and the bits of the words that aren't 0.
        top, words = 0, {}
        for r in buckets:
            words[r >> BITS] = words.get(r >> BITS, 0) | 1 << (r & MASK)
            top |= 1 << (r >> BITS)
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            bit = bits & -bits
            rank = w << BITS | bit.bit_length() - 1
            words[w] = bits = bits ^ bit
            if not bits:
                top &= top - 1
            places = buckets.pop(rank)
            places.sort()
            hold, fresh = 0, []
            for i in places:
                if rank_at[i] != rank:  # stale
                    continue
                if i < hold:  # a lower rank has come up in this pre-token
                    fresh.append((rank, i))
                    continue
                j = stop[i]
                stop[i] = e = stop[j]
                rank_at[i] = rank_at[j] = -1
                alive[j] = 0
                ids[i] = rank
                if not edges[e]:
                    back[e] = i
                    if (r := get(whole[i : stop[e]])) is not None:
                        rank_at[i] = r
                        fresh.append((r, i))
                        if r < rank:
                            hold = edges.find(1, i + 1)
                if (h := back[i]) >= 0:
                    if (r := get(whole[h:e])) is not None:
                        rank_at[h] = r
                        fresh.append((r, h))
                        if r < rank:
                            hold = edges.find(1, i + 1)
                    else:
                        rank_at[h] = -1
            for r, i in fresh:
                if (bucket := buckets.get(r)) is not None:
                    bucket.append(i)
                else:
                    buckets[r] = [i]
                    w = r >> BITS
                    words[w] = words.get(w, 0) | 1 << (r & MASK)
                    top |= 1 << w
        kept = np.frombuffer(bytes(alive), dtype=np.uint8)
        return np.array(ids, dtype=np.int32)[kept == 1], np.add.reduceat(kept, ends - np.diff(ends, prepend=0), dtype=np.int64)

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        known = self.ranks.get(piece)
        return [known] if known is not None else self.encode_pieces([piece])[0].tolist()

    def encode_runs(self, runs: list[str]) -> tuple[list[int], list[int]]:
        """The ids of the runs, one after the other, and how many each has."""
        cut = [_PRE.findall(run) for run in runs]
        pieces = set().union(*cut)
        raw = {p: p.encode("utf-8", "surrogatepass") for p in pieces}
        found = {p: [r] for p, b in raw.items() if (r := self.ranks.get(b)) is not None}
        rest = [p for p in raw if p not in found]
        if rest:
            ids, counts = self.encode_pieces([raw[p] for p in rest])
            ids, at = ids.tolist(), 0
            for p, count in zip(rest, counts.tolist()):
                found[p] = ids[at : at + count]
                at += count
        flat, lengths = [], []
        for own in cut:
            before = len(flat)
            for p in own:
                flat += found[p]
            lengths.append(len(flat) - before)
        return flat, lengths

    def encode(self, text: str) -> list[int]:
        return self.encode_runs(_RUNS.findall(text))[0]

    def decode(self, ids: list[int | None]) -> str:
        return b"".join([self.pieces[x] for x in ids if x is not None]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts in bulk: the ids of the runs met so far lie one after the other."""

    def __init__(self, codec: Codec, memory: int = MEMORY) -> None:
        self.codec, self.memory = codec, memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.flat, self.ends = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _learn(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 4_000):
            part = runs[at : at + 4_000]
            fresh, lengths = self.codec.encode_runs(part)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            self.letters += sum(map(len, part))
            self.flat = np.concatenate([self.flat, np.array(fresh, dtype=np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.known) > self.memory or self.letters > LETTERS:
            self.forget()
        found = [_RUNS.findall(t) for t in texts]
        self._learn(list(set().union(*found).difference(self.known)))
        number = np.fromiter((self.known[r] for runs in found for r in runs), dtype=np.int64)
        starts, lengths = self.ends[number], self.ends[number + 1] - self.ends[number]
        per = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per)])]
        return self.flat[ranges(starts, lengths)], np.diff(cuts)


class Decoder:
    """Decodes ids in bulk: the bytes of the vocabulary lie one after the other."""

    def __init__(self, codec: Codec) -> None:
        most = max(codec.pieces)
        parts = [codec.pieces.get(k, b"") for k in range(most + 1)]
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, parts), dtype=np.int64, count=most + 1)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of counts ids."""
        lengths = self.lengths[ids]
        whole = self.flat[ranges(self.starts[ids], lengths)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_codecs: dict[str, tuple[Codec, Encoder, Decoder]] = {}


def _shipped(spark: SparkSession, path: str) -> None:
    """Sends the vocabulary to executors that don't have it at its path."""
    if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


def _codec(path: str) -> tuple[Codec, Encoder, Decoder]:
    """One worker's codec, with what it remembers."""
    if path not in _codecs:
        codec = Codec.load(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        _codecs[path] = codec, Encoder(codec), Decoder(codec)
    return _codecs[path]


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, ids (array<int>), n_tokens, round_trip: whether decoding the ids gives the text again."""
    _shipped(docs.sparkSession, path)
    source = docs.select(F.col(key), text_of(docs, text).alias("__aw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, decoder = _codec(path)
        for batch in slices(batches, "__aw_text", 2_000_000):
            texts = batch.column(1).to_pylist()
            ids, counts = encoder.encode(texts)
            same = [a == b.encode("utf-8", "surrogatepass") for a, b in zip(decoder.decode(ids, counts), texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(counts), pa.array(same)], names=[key, "ids", "n_tokens", "round_trip"])

    return source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns key, text of rows with an array of ids."""
    _shipped(tokens.sparkSession, path)
    source = tokens.select(F.col(key), F.filter(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("__aw_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _codec(path)[2]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(1)
                counts = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
                texts = [b.decode("utf-8", "replace") for b in decoder.decode(np.asarray(lists.flatten(), dtype=np.int64), counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, text string")
