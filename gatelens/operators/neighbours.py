"""Exact nearest neighbours: blocks of packed rows, each held against all blocks that share a group with it.

Rows are sorted by group and id and packed into blocks, a row of the table each. Spark's cartesian product rereads the
packed table for each share of the blocks that ask, so that no vector is shuffled more than once however many blocks there
are. A task keeps the best rows so far of one block that asks, and what it holds is bounded by PART and BLOCK. Work grows
with the square of a group; what is written and shuffled grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.vectors import doubles
from gatelens.sources.scratch import saved

#: Bytes of a block, and its most rows; bytes of packed rows that a task reads through for its blocks; rows of a comparison.
BLOCK, ROWS, PART, TILE = 6 << 20, 4096, 128 << 20, 512


def packed(df: DataFrame, by: str | None, key: str, vector: str) -> DataFrame:
    """_lo, _hi (least and largest group), _gs, _ids and _v (vectors as bytes of doubles) of blocks of rows in the order of group and id."""
    x = df.select((F.col(by) if by else F.lit(0)).alias("_g"), F.col(key).alias("_id"), doubles(vector).alias("_v")).where("_g is not null")
    x = x.repartitionByRange("_g", "_id").sortWithinPartitions("_g", "_id")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, ROWS
        for b in batches:
            if not b.num_rows:
                continue
            dim = len(b.column(2)[0])
            most = max(256, min(ROWS, BLOCK // (8 * max(dim, 1))))
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            at = 0
            while at < b.num_rows:
                n = min(most - rows, b.num_rows - at)
                held.append((b.column(0).slice(at, n), b.column(1).slice(at, n), v[at : at + n]))
                rows, at = rows + n, at + n
                if rows >= most:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    def block(held) -> pa.RecordBatch:
        g, i = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        whole = pa.array([0, len(g)], pa.int32())
        v = np.ascontiguousarray(np.concatenate([h[2] for h in held]), np.float64)
        return pa.RecordBatch.from_arrays([g[:1], g[-1:], pa.ListArray.from_arrays(whole, g), pa.ListArray.from_arrays(whole, i), pa.array([v.tobytes()], pa.binary())], ["_lo", "_hi", "_gs", "_ids", "_v"])

    return x.mapInArrow(pack, f"_lo {kinds['_g']}, _hi {kinds['_g']}, _gs array<{kinds['_g']}>, _ids array<{kinds['_id']}>, _v binary")


def values(a: pa.Array) -> np.ndarray:
    """Numbers as they are, other values as texts."""
    return a.to_numpy(zero_copy_only=False) if pa.types.is_integer(a.type) or pa.types.is_floating(a.type) else np.array([str(v) for v in a.to_pylist()])


def keep_nearest(near: np.ndarray, who: np.ndarray, d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each row, and whose they are, of those it has (near, who) and new ones (d, ids); ties by id. Infinite ones don't count; ids rise."""
    n, k = near.shape
    most = near[:, -1]
    if d.shape[1] > k and np.isinf(most).any():
        most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
    mask = (d <= most[:, None]) & np.isfinite(d)
    crowd = np.flatnonzero(mask.sum(axis=1) > 4 * k)
    for r in crowd:  # many at the same distance: those of the least ids are enough
        own = np.flatnonzero(mask[r])
        mask[r] = False
        mask[r, own[np.argsort(d[r, own], kind="stable")[:k]]] = True
    r, c = np.nonzero(mask)
    if not len(r):
        return near, who
    old, at = np.nonzero(np.isfinite(near))
    row, dist, name = np.concatenate([old, r]), np.concatenate([near[old, at], d[r, c]]), np.concatenate([who[old, at], ids[c]])
    order = np.lexsort((name, dist, row))
    row, dist, name = row[order], dist[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    good = place < k
    near, who = np.full((n, k), np.inf, np.float32), np.zeros((n, k), name.dtype)
    near[row[good], place[good]], who[row[good], place[good]] = dist[good], name[good]
    return near, who


class Asked:
    """A block that asks, and the nearest rows so far."""

    def __init__(self, groups: pa.Array, ids: pa.Array, v: np.ndarray, k: int, cosine: bool):
        self.groups, self.keys, self.g, self.ids, self.v, self.cosine = groups, ids, values(groups), values(ids), v, cosine
        tiles = [slice(i, min(i + TILE, len(v))) for i in range(0, len(v), TILE)]
        self.tiles = [(t, np.full((t.stop - t.start, k), np.inf, np.float32), np.zeros((t.stop - t.start, k), self.ids.dtype)) for t in tiles]

    def meet(self, g: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        one = self.g[0] == self.g[-1] == g[0] == g[-1]  # groups are sorted
        if not one:
            names, code = np.unique(np.concatenate([self.g, g]), return_inverse=True)
            mine, theirs = code[: len(self.g)], code[len(self.g) :]
        length = (v * v).sum(1)
        for i, (t, near, who) in enumerate(self.tiles):
            a, b, ids_, sq = self.v[t], v, ids, length
            if not one:
                at = np.flatnonzero((theirs >= mine[t].min()) & (theirs <= mine[t].max()))
                if not len(at):
                    continue
                b, ids_, sq = v[at], ids[at], length[at]
            d = 1 - a @ b.T if self.cosine else np.sqrt(np.maximum((a * a).sum(1)[:, None] + sq[None] - 2 * a @ b.T, 0))
            d = d.astype(np.float32)
            if not one:
                d[mine[t][:, None] != theirs[at][None]] = np.inf
            if np.isin(self.ids[t], ids_).any():
                d[self.ids[t][:, None] == ids_[None]] = np.inf
            self.tiles[i] = (t, *keep_nearest(near, who, d, ids_))

    def found(self) -> Iterator[pa.RecordBatch]:
        for t, near, who in self.tiles:
            r, c = np.nonzero(np.isfinite(near))
            if len(r):
                at = pa.array(r + t.start)
                name = who[r, c]
                name = pa.array(name) if name.dtype.kind != "U" else pa.array(name.tolist())
                yield pa.RecordBatch.from_arrays([self.groups.take(at), self.keys.take(at), pa.array((c + 1).astype(np.int32)), name.cast(self.keys.type), pa.array(near[r, c])], ["_g", "_id", "rank", "neighbour", "distance"])


def knn(df: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", by: str | None = None) -> DataFrame:
    """by, key, rank, neighbour, distance: the k nearest others in the group, ties by id, written once. cosine takes unit rows."""
    blocks = saved(packed(df, by, key, vector))
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("_v")), F.lit(0))).first()
    parts = max(1, math.ceil(size / PART))
    shares = max(1, min(n, 4 * df.sparkSession.sparkContext.defaultParallelism))
    asked = blocks.repartition(shares).select(*[F.col(c).alias(f"_a{c}") for c in blocks.columns])
    pairs = asked.hint("shuffle_replicate_nl").join(blocks.coalesce(parts), (F.col("_a_lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("_a_hi")))
    pairs = pairs.select("_a_gs", "_a_ids", "_a_v", "_gs", "_ids", "_v")
    cosine = metric == "cosine"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1)
                ids, raw = x.column(1).flatten(), x.column(2)[0].as_buffer()
                # pairs come block by block of those that ask
                if now is None or raw.size != seen.size or not ids.equals(now.keys) or not raw.equals(seen):
                    if now is not None:
                        yield from now.found()
                    seen = pa.py_buffer(raw.to_pybytes())
                    now = Asked(x.column(0).flatten(), ids, np.frombuffer(seen).reshape(len(ids), -1), k, cosine)
                other = x.column(4).flatten()
                now.meet(values(x.column(3).flatten()), values(other), np.frombuffer(x.column(5)[0].as_buffer()).reshape(len(other), -1))
        if now is not None:
            yield from now.found()

    kinds = {c: blocks.schema[c].dataType for c in ("_gs", "_ids")}
    g, i = (kinds[c].elementType.simpleString() for c in ("_gs", "_ids"))
    found = pairs.mapInArrow(compare, f"_g {g}, _id {i}, rank int, neighbour {i}, distance float")
    if parts > 1:  # each part of the table gave its nearest
        rank = F.row_number().over(Window.partitionBy("_g", "_id").orderBy("distance", "neighbour"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return saved(found.select(*([F.col("_g").alias(by)] if by else []), F.col("_id").alias(key), "rank", "neighbour", "distance"))
