"""Out-of-fold ensemble of kernel and linear ridge members: how far an output's offset is from what its input predicts.

Kernel members map inputs to Nystroem features of sampled landmarks, low-rank members cut the coefficients' rank; each sees
its own random projection and its own share of the rows. Sums of products per fold and member are taken on the executors;
members are solved on the driver from them, which are as large as the features are wide, whatever the rows. Residuals are
then robust z against those of the rows a member was trained on, fused by reliability, half a weight to either family.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.vectors import sanitize
from gatelens.operators import kernels
from gatelens.sources.scratch import saved

ALPHA = 0.1
RANKS = (16, 32)
DIMS = 96
MEMBERS = 4
SUBSAMPLE = 0.85
#: Folds at any number of rows, dealt by a hash of the key.
FOLDS = 5
#: Landmarks at most, and rows of the sample they and gamma are taken from.
LANDMARKS, GAMMA_ROWS = 512, 256


@dataclass
class Member:
    """Maps inputs to features; its seed tells its rows."""

    seed: int
    family: str
    rank: int
    dims: int
    landmarks: np.ndarray | None = None
    gamma: float = 1.0
    root: np.ndarray | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        p = kernels.projection(x.shape[1], self.dims, self.seed)
        return x if p is None else x @ p

    def features(self, x: np.ndarray) -> np.ndarray:
        z = self.projected(x)
        return z if self.landmarks is None else kernels.rbf(z, self.landmarks, self.gamma) @ self.root

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The rows it is trained on."""
        mixed = (hashes.view(np.uint64) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(40)).astype(np.float64) / 2**24 < SUBSAMPLE


def stacked(a: pa.ListArray) -> np.ndarray:
    """Rows of lists of one length."""
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def lists(v: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the rows of v, null where missing."""
    return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(np.ascontiguousarray(v).ravel(), mask=None if missing is None else missing.ravel()))


def _members(sample: np.ndarray, n: int, members: int) -> list[Member]:
    out = [Member(42 + 97 * i, "lowrank", RANKS[i % len(RANKS)], DIMS) for i in range(members)]
    m = max(2, min(LANDMARKS, math.ceil(math.sqrt(max(n, 1)))))
    for i in range(members):
        k = Member(1042 + 97 * i, "kernel", 0, DIMS)
        z = k.projected(sample)
        at = np.random.default_rng(k.seed).permutation(len(z))
        k.landmarks, k.gamma = z[at[:m]], kernels.gamma_of(z[at[:GAMMA_ROWS]])
        k.root = kernels.nystroem(k.landmarks, k.gamma)
        out.append(k)
    return out


def ensemble_signal(rows: DataFrame, key: str, x: str, y: str, weight: str | None = None, members: int = MEMBERS) -> DataFrame:
    """key, delta_ridge: fused positive robust z of 1 - cosine between y and its out-of-fold predictions from x. No rows, no result."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at = saved(rows.select(
        F.col(key).alias("_k"), F.xxhash64(F.lit(7), key).alias("_h"), F.pmod(F.xxhash64(F.lit(42), F.col(key)), F.lit(FOLDS)).cast("int").alias("_f"), w.alias("_w"), sanitize(x).alias("_x"), sanitize(y).alias("_y"),
    ))
    n, folds = at.count(), FOLDS
    if not n:
        return at.select(F.col("_k").alias(key), F.lit(0.0).alias("delta_ridge"))
    wanted = max(GAMMA_ROWS, min(LANDMARKS, math.ceil(math.sqrt(n))) * 2)
    sample = np.array([r[0] for r in at.select("_x", "_h").orderBy("_h").limit(wanted).select("_x").collect()])  # a bounded sample, by a hash
    team = _members(sample, n, members)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            h, f, w = (b.column(i).to_numpy() for i in (1, 2, 3))
            xs, ys = stacked(b.column(4)), stacked(b.column(5))
            for i, m in enumerate(team):
                a, own = np.column_stack([np.ones(len(xs)), m.features(xs)]), m.rows(h) * np.maximum(w, 0)
                for k in np.unique(f).tolist():
                    mine = f == k
                    part, whole = a[mine], a[mine] * own[mine, None]
                    s = np.concatenate([(whole.T @ part).ravel(), (whole.T @ ys[mine]).ravel()])
                    if (k, i) in total:
                        total[k, i] += s
                    else:
                        total[k, i] = s
        if total:
            ks = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ks], pa.int32()), pa.array([k[1] for k in ks], pa.int32()), pa.array([total[k].tobytes() for k in ks], pa.binary())], ["f", "m", "s"])

    def add(key_, pdf):
        import pandas as pd

        return pd.DataFrame({"f": [int(key_[0])], "m": [int(key_[1])], "s": [np.sum([np.frombuffer(v) for v in pdf["s"]], axis=0).tobytes()]})

    got = at.mapInArrow(sums, "f int, m int, s binary").groupBy("f", "m").applyInPandas(add, "f int, m int, s binary").collect()  # a row per fold and member
    held = {(r.f, r.m): np.frombuffer(bytes(r.s)) for r in got}
    fitted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    d = len(at.select("_y").first()[0])
    for k in range(folds):
        own = []
        for i, m in enumerate(team):
            s = sum((v for (f, j), v in held.items() if j == i and f != k), np.zeros(()))
            p = int(round((-d + math.sqrt(d * d + 4 * s.size)) / 2)) if s.size > 1 else 1
            if s.size <= 1 or s.flat[0] <= 0:
                own.append((np.zeros((p - 1, d)), np.zeros(d)))
                continue
            g, c = s[: p * p].reshape(p, p), s[p * p :].reshape(p, d)
            mx, my = g[0, 1:] / g[0, 0], c[0] / g[0, 0]
            coef, bias = kernels.solve_ridge(g[1:, 1:] - g[0, 0] * np.outer(mx, mx), c[1:] - g[0, 0] * np.outer(mx, my), mx, my, ALPHA)
            own.append((kernels.low_rank(coef, m.rank) if m.rank else coef, bias))
        fitted.append(own)
    # as wide as the features, whatever the rows; plain values, as a broadcast travels without the code
    fit = rows.sparkSession.sparkContext.broadcast(([vars(m) for m in team], fitted))

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fitted = fit.value
        team = [Member(**m) for m in held]
        for b in batches:
            if not b.num_rows:
                continue
            h, f = b.column(1).to_numpy(), b.column(2).to_numpy()
            xs, ys = stacked(b.column(4)), stacked(b.column(5))
            out, used = np.zeros((len(xs), len(fitted), len(team))), np.zeros((len(xs), len(team)), bool)
            for i, m in enumerate(team):
                z = m.features(xs)
                used[:, i] = m.rows(h)
                for k, own in enumerate(fitted):
                    c, bias = own[i]
                    out[:, k, i] = kernels.cosine_residual(ys, (z @ c if c.shape[0] == z.shape[1] else 0) + np.broadcast_to(bias, ys.shape))
            train = np.broadcast_to(used[:, None], out.shape) & (f[:, None] != np.arange(len(fitted)))[:, :, None]
            own_fold = out[np.arange(len(xs)), f]
            cols = [lists(own_fold), lists(out.reshape(len(xs), -1), ~train.reshape(len(xs), -1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["_k", "_f", "own", "train"])

    kind = rows.schema[key].dataType.simpleString()
    scored = saved(at.mapInArrow(residuals, f"_k {kind}, _f int, own array<double>, train array<double>"))
    cells = len(fitted) * len(team)
    med = scored.select(F.posexplode("train").alias("i", "v")).where("v is not null").groupBy("i").agg(F.median("v").alias("m"))
    mad = scored.select(F.posexplode("train").alias("i", "v")).where("v is not null").join(F.broadcast(med), "i").groupBy("i", "m").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("s")).collect()  # a row per fold and member
    m, s = np.zeros(cells), np.zeros(cells)
    for r in mad:
        m[r.i], s[r.i] = r.m, r.s
    m, s = m.reshape(len(fitted), len(team)), s.reshape(len(fitted), len(team))
    family = np.array([t.family == "kernel" for t in team])

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f, own = b.column(1).to_numpy(), stacked(b.column(2))
            out = np.zeros(len(own))
            for k in np.unique(f).tolist():
                at_ = f == k
                for kind_ in (True, False):
                    pick = family == kind_
                    out[at_] += 0.5 * kernels.fuse(own[at_][:, pick].T, m[k][pick], s[k][pick])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], [key, "delta_ridge"])

    return scored.select("_k", "_f", "own").mapInArrow(fused, f"`{key}` {kind}, delta_ridge double")
