"""Embedding near-duplicates by int8 quantised tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised once, each to int8 with a scale of its own, u = s * q + e; the length of the
error e is kept, rounded up. For a pair, the product of the quantised vectors is exact (whole numbers of less than 2 ** 24
times two scales) and by Cauchy-Schwarz

    |<u, v> - s t <q, r>|  <=  |e| |t r| + |s q| |f| + |e| |f|   with |s q| <= 1 + |e|.

A pair whose quantised product plus this bound stays below the threshold can't reach it, and one whose product less the bound
is above it must; only the pairs between, which are possibly above, are computed again in full precision, from vectors that
are fetched for them alone. The result is exact: every vector is a query against all others, nothing is sampled.

Tiles. Rows are hashed to G tiles, of TILE_BYTES of int8 at most, which is what a task holds of either side, and never fewer
than keep all cores busy. Tile k is the home of a task that meets tiles k, k + 1, ..., k + G / 2 around the circle, so every
pair of tiles meets once and all tasks have the same work. A tile is packed once and sent to the homes that it meets: bytes
exchanged are a quarter of the vectors' times G / 2. Products grow with the square of the rows, as those of any exact search
must where the vectors have no structure.

Groups of copies. The pairs of a group are counted where they are found, never emitted: a task returns for each vector the
number of its links, and for each pair of tiles one edge for each pair of groups, the groups of a tile being known before it
is sent. So a group of any size costs a few rows for each pair of tiles that it is in.

The result has a row for each id: its class, which is the least id that it is connected with by links, and its links: how many
rows of other ids have a similarity of threshold or more with a row of its own, rows alike in id and vector counting once.

Edge cases: a null id has no row; a null vector, one with a null or a value that isn't finite, and one of length 0 have no
links; vectors of different dimensions are never compared; equal vectors under different ids are linked, rows that share an id
never; repeated rows count once; an empty table gives an empty table; further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrweave.llm.common import components, lean, pack, unpack, written

THRESHOLD = 0.95
#: Bytes of int8 vectors of a tile at most, and vectors below which a tile isn't split for the sake of more tasks.
TILE_BYTES, LEAST = 8 << 20, 2048
_BLOCK = 1024  # rows of a product held at a time
_SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; rows that can't be are 0."""
    wide = vectors.astype(np.float64)
    wide[~np.isfinite(wide).all(axis=1)] = 0
    top = np.abs(wide).max(axis=1, initial=0)
    wide /= np.where(top > 0, top, 1)[:, None]
    length = np.sqrt((wide * wide).sum(axis=1))
    return wide / np.where(length > 0, length, 1)[:, None]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scales, lengths of the errors, rounded up)."""
    scale = (np.abs(units).max(axis=1, initial=0) / 127).astype(np.float32)
    scale = np.where(scale > 0, scale, np.float32(1))
    wide = scale.astype(np.float64)
    q = np.clip(np.rint(units / wide[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((units - q * wide[:, None]) ** 2).sum(axis=1))
    return q, scale, np.nextafter((error + 1e-12).astype(np.float32), np.float32(np.inf))


@dataclass
class Tile:
    """Rows of one dimension: ids, hashes of the vectors, quantised vectors, the least id of each row's group inside the tile."""

    id: np.ndarray
    hash: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    label: np.ndarray

    def __post_init__(self) -> None:
        # Products of int8 in single precision are exact as long as dimension * 127 ** 2 stays below 2 ** 24.
        self.wide = self.q.astype(np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        self.scale, self.error = self.scale.astype(np.float64), self.error.astype(np.float64)


def judged(a: Tile, b: Tile, rows: slice, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, sure) of the pairs of a block that are possibly above the threshold; sure: they are."""
    s, t, e, f = a.scale[rows], b.scale[columns], a.error[rows], b.error[columns]
    whole = a.wide[rows] @ b.wide[columns].T
    x, y = e.max(), f.max()
    # No pair of the block can be possible below this; what is left, few, is held against its own bound.
    i, j = np.nonzero(whole >= (threshold - _SLACK - (x * (1 + y) + y * (1 + x) + x * y)) / (s.max() * t.max()) * (1 - 1e-6))
    product, bound = whole[i, j] * (s[i] * t[j]), e[i] * (1 + f[j]) + f[j] * (1 + e[i]) + e[i] * f[j] + _SLACK
    possible = product >= threshold - bound
    i, j = i[possible], j[possible]
    return i + (rows.start or 0), j + (columns.start or 0), product[possible] >= threshold + bound[possible]


def connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j; root is the least node of each node's group, before and after."""
    while True:
        apart = root[i] != root[j]
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


def _blocks(rows: int) -> list[slice]:
    return [slice(at, min(at + _BLOCK, rows)) for at in range(0, rows, _BLOCK)]


def met(a: Tile, b: Tile | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles, or of one with itself: links of a's rows, of b's, edges between labels, pairs in doubt (rows of a, of b)."""
    own, other = np.zeros(len(a.id), dtype=np.int64), np.zeros(len((b or a).id), dtype=np.int64)
    edges, doubts = [], []
    root = np.arange(len(a.id))
    for rows in _blocks(len(a.id)):
        for columns in _blocks(len((b or a).id)):
            if b is None and columns.start < rows.start:
                continue
            i, j, sure = judged(a, b or a, rows, columns, threshold)
            fit = a.id[i] != (b or a).id[j]
            if b is None:
                fit &= i < j
            i, j, sure = i[fit], j[fit], sure[fit]
            if (~sure).any():
                doubts.append(np.column_stack([i[~sure], j[~sure]]))
            i, j = i[sure], j[sure]
            if len(i):
                np.add.at(own, i, 1)
                np.add.at(other, j, 1)
                if b is None:
                    connect(root, i, j)
                else:
                    edges.append(np.unique(np.column_stack([a.label[i], b.label[j]]), axis=0))
    if b is None:
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, a.id)
        a.label = least[root]
        own, edges = own + other, [np.column_stack([a.id, a.label])]
    none = np.empty((0, 2), dtype=np.int64)
    found = np.unique(np.concatenate([none, *edges]), axis=0)
    found = found[found[:, 0] != found[:, 1]]
    return own, other, found, *np.concatenate([none, *doubts]).T


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows part, id, hash, scale, error, q of rows id, hash, part, v; each once a batch."""
    for batch in batches:
        column = batch.column(3)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
        for dimension in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dimension)
            keys = np.column_stack([batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows]])
            rows = rows[np.unique(keys, axis=0, return_index=True)[1]]
            flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
            units = unit(np.asarray(flat.fill_null(float("nan"))).reshape(-1, dimension))
            live = units.any(axis=1)
            if live.any():
                q, scale, error = quantise(units[live])
                at = pa.array(rows[live])
                packed = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer((np.arange(len(q) + 1) * dimension).astype(np.int32)), pa.py_buffer(q.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), batch.column(1).take(at), pa.array(scale), pa.array(error), packed], names=["part", "id", "hash", "scale", "error", "q"])


def _tiles(threshold: float):
    """Rows part, dimension, body, own, of one part: its tiles, and what each finds inside itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        sizes, part = np.asarray(pa.compute.binary_length(table["q"])), table["part"][0].as_py()
        for dimension in np.unique(sizes).tolist():
            rows = table.filter(pa.array(sizes == dimension)).combine_chunks()
            ids, hashes = rows["id"].to_numpy(), rows["hash"].to_numpy()
            once = np.unique(np.column_stack([ids, hashes]), axis=0, return_index=True)[1]
            q = np.frombuffer(b"".join(rows["q"].to_pylist()), dtype=np.int8).reshape(-1, dimension)[once]
            tile = Tile(ids[once], hashes[once], q, rows["scale"].to_numpy()[once], rows["error"].to_numpy()[once], ids[once])
            links, _, edges, i, j = met(tile, None, threshold)
            body = pack(tile.id, tile.hash, tile.q.reshape(-1), tile.scale.astype(np.float32), tile.error.astype(np.float32), tile.label)
            own = pack(links, edges[:, 0], edges[:, 1], i, j)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dimension], pa.int32()), pa.array([body], pa.binary()), pa.array([own], pa.binary())], names=["part", "dimension", "body", "own"])

    return run


_FOUND = "kind int, a long, ha long, b long, hb long, n long"
_LINKS, _EDGE, _DOUBT = 0, 1, 2


def _rows(kind: int, a: np.ndarray, b: np.ndarray | None = None, ha: np.ndarray | None = None, hb: np.ndarray | None = None, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    none = np.zeros(len(a), dtype=np.int64)
    for at in range(0, len(a), 50_000):
        columns = [pa.array((none if x is None else x)[at : at + 50_000].astype(np.int64)) for x in (a, ha, b, hb, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *columns], names=["kind", "a", "ha", "b", "hb", "n"])


def _meetings(threshold: float):
    """What a home's tiles find with those that come to it; rows step, dimension, body, own in order of step, 0 its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home: dict[int, Tile] = {}
        links: dict[int, np.ndarray] = {}
        for batch in batches:
            for step, dimension, body, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if step and dimension not in home:
                    continue
                ids, hashes, q, scale, error, label = unpack(body.as_py())
                tile = Tile(ids, hashes, q.reshape(-1, dimension), scale, error, label)
                if step == 0:
                    home[dimension] = tile
                    links[dimension], *edge, i, j = unpack(own.as_py())
                    links[dimension] = links[dimension].copy()
                    yield from _rows(_EDGE, *edge)
                    yield from _rows(_DOUBT, ids[i], ids[j], hashes[i], hashes[j])
                    continue
                mine = home[dimension]
                more, theirs, edges, i, j = met(mine, tile, threshold)
                links[dimension] += more
                yield from _rows(_LINKS, ids[theirs > 0], n=theirs[theirs > 0])
                yield from _rows(_EDGE, edges[:, 0], edges[:, 1])
                yield from _rows(_DOUBT, mine.id[i], ids[j], mine.hash[i], hashes[j])
        for dimension, own in links.items():
            yield from _rows(_LINKS, home[dimension].id[own > 0], n=own[own > 0])

    return run


def _exact(threshold: float):
    """The rows a, b, of rows a, b, va, vb whose similarity in full precision is threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for dimension in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == dimension))
                x, y = (unit(np.asarray(batch.column(k).take(rows).flatten().cast(pa.float64())).reshape(-1, dimension)) for k in (2, 3))
                part = batch.select(["a", "b"]).take(rows)
                yield part.filter(pa.array((x * y).sum(axis=1) >= threshold))

    return run


def near_copies(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES, least: int = LEAST) -> DataFrame:
    """Columns key, class_id, links of each id: the least id that it is connected with, and its rows of a cosine similarity of
    threshold or more."""
    spark = table.sparkSession
    v = F.col(vector)
    source = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.size(v), v).alias("hash"), v.alias("v"))
    rows, size = source.agg(F.count("*"), F.sum(F.greatest(F.size("v"), F.lit(0)))).first()
    tiles = max(1, min(-(-rows // least), 2 * spark.sparkContext.defaultParallelism), -(-(size or 0) // tile_bytes))
    part = F.pmod(F.xxhash64("hash", "id"), F.lit(tiles)).cast("int")
    quantised = source.filter(F.col("v").isNotNull()).select("id", "hash", part.alias("part"), "v").mapInArrow(lean(_quantised), "part int, id long, hash long, scale float, error float, q binary")
    held = written(quantised.repartitionById(tiles, "part").mapInArrow(lean(_tiles(threshold)), "part int, dimension int, body binary, own binary"), "embedding-tiles")
    far = tiles // 2
    sent = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(far))).alias("step"))
    sent = sent.withColumn("home", F.pmod(F.col("part") - F.col("step"), F.lit(tiles)).cast("int"))
    if tiles > 1 and tiles % 2 == 0:  # opposite tiles would meet twice
        sent = sent.filter((F.col("step") < far) | (F.col("home") < F.col("part")))
    sent = sent.select("home", "step", "dimension", "body", F.when(F.col("step") == 0, F.col("own")).alias("own"))
    at_home = sent.repartitionById(tiles, "home").sortWithinPartitions("step").select("step", "dimension", "body", "own")
    found = written(at_home.mapInArrow(lean(_meetings(threshold)), _FOUND), "embedding-meetings")
    links = found.filter(F.col("kind") == _LINKS).select(F.col("a").alias("id"), "n")
    edges = found.filter(F.col("kind") == _EDGE).select("a", "b")
    doubts = found.filter(F.col("kind") == _DOUBT)
    if doubts.limit(1).count():
        # Vectors are fetched for the rows in doubt alone.
        named = doubts.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("ha").alias("hash")), F.struct(F.col("b").alias("id"), F.col("hb").alias("hash"))))).distinct()
        full = written(source.join(named, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.first("v").alias("v")), "embedding-vectors")
        left, right = full.select(F.col("id").alias("a"), F.col("hash").alias("ha"), F.col("v").alias("va")), full.select(F.col("id").alias("b"), F.col("hash").alias("hb"), F.col("v").alias("vb"))
        pairs = doubts.select("a", "ha", "b", "hb").join(left, ["a", "ha"]).join(right, ["b", "hb"]).select("a", "b", "va", "vb")
        sure = written(pairs.mapInArrow(lean(_exact(threshold)), "a long, b long"), "embedding-exact")
        edges = edges.unionByName(sure)
        links = links.unionByName(sure.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n")))
    counted = links.groupBy("id").agg(F.sum("n").alias("links"))
    classes = components(edges)
    ids = source.select("id").distinct().join(counted, "id", "left").join(classes, F.col("id") == classes["node"], "left")
    return ids.select(F.col("id").alias(key), F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


#: DuckDB's restatement of near_copies() over embeddings.
SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
d AS (SELECT DISTINCT a, b FROM p),
r(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
n AS (SELECT a, count(*) AS links FROM p GROUP BY a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT i.vec_id, CAST(least(i.vec_id, coalesce(c.least, i.vec_id)) AS BIGINT) AS class_id, CAST(coalesce(n.links, 0) AS BIGINT) AS links
FROM (SELECT DISTINCT vec_id FROM e) i LEFT JOIN n ON n.a = i.vec_id LEFT JOIN c ON c.a = i.vec_id
"""
